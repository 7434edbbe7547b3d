"""Run configurations: files of key = value lines, with comments after #."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """A run's parameters. Missing ones have the defaults below."""

    image_file: str = ""
    log_file: str = ""
    channels: int = 1
    threads: int = 1
    random_images: bool = False
    width: int = 0
    height: int = 0
    algorithm: str = "FloodHierHeapQueue"
    metric: str = "L2"
    bits: int = 8
    size_estimate: bool = False
    connectivity: int = 4
    iterations: int = 1
    integers: tuple[int, ...] = (3, 2, 3)
    floats: tuple[float, ...] = (15.0, 0.15, 0.3)


# Keys of configuration files. The algorithm's key is any that ends in Algorithm.
KEYS = {
    "ImageFileName": "image_file",
    "LogFileName": "log_file",
    "NumberOfChannels": "channels",
    "NumberOfThreads": "threads",
    "UseRandomlyGeneratedImages": "random_images",
    "RandomlyGeneratedImageWidth": "width",
    "RandomlyGeneratedImageHeight": "height",
    "DissimilarityMetric": "metric",
    "BitDepth": "bits",
    "UseTreeSizeEstimation": "size_estimate",
    "Connectivity": "connectivity",
    "NumberOfTestIterations": "iterations",
}


def trim(text: str) -> str:
    return text.strip(" \t\r\n\f\v")


def parse(text: str) -> dict[str, str]:
    """Keys and values; what follows # on a line, and lines without =, are left out. A later line of a key counts."""
    found = {}
    for line in text.splitlines():
        line, _, _ = line.partition("#")
        key, there, value = line.partition("=")
        if there:
            found[trim(key)] = trim(value)
    return found


def get_string(values: dict[str, str], key: str, default: str = "") -> str:
    return values.get(key) or default


def get_integer(values: dict[str, str], key: str, default: int = -1) -> int:
    """A whole number; an error names the key of a value that isn't one."""
    try:
        return int(values[key]) if values.get(key) else default
    except ValueError as e:
        raise ValueError(f"{key}: {values[key]!r} is not a whole number") from e


def get_double(values: dict[str, str], key: str, default: float = -1.0) -> float:
    try:
        return float(values[key]) if values.get(key) else default
    except ValueError as e:
        raise ValueError(f"{key}: {values[key]!r} is not a number") from e


def load(text: str) -> Config:
    """The configuration of a file's text; unknown algorithms raise an error."""
    from gridgrove.plans.api import strategy

    values, made, plain = parse(text), {}, Config()
    for key, name in KEYS.items():
        if values.get(key):
            default = getattr(plain, name)
            made[name] = bool(get_integer(values, key)) if isinstance(default, bool) else get_integer(values, key) if isinstance(default, int) else get_string(values, key)
    for key, value in values.items():
        if key.endswith("Algorithm") and value:
            strategy(value)
            made["algorithm"] = value
    for name, getter, key in (("integers", get_integer, "ParameterInteger"), ("floats", get_double, "ParameterFloat")):
        made[name] = tuple(getter(values, f"{key}{k + 1}", d) for k, d in enumerate(getattr(plain, name)))
    return Config(**made)
