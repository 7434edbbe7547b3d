"""The operators' queries over the driver tables, and SQL for those that SQL can express."""

from gridgrove.llm import decontaminate, html, jaccard, language, lmscore, mixing, neighbours, pii, secrets, toxicity

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_lmscore": lmscore.op3_lmscore,
    "op4_mixing": mixing.op4_mixing,
    "op5_html": html.op5_html,
    "op6_language": language.op6_language,
    "op7_jaccard": jaccard.op7_jaccard,
    "op8_neighbours": neighbours.op8_neighbours,
    "op9_secrets": secrets.op9_secrets,
    "op10_pii": pii.op10_pii,
}

SQL = {
    "op1_decontaminate": decontaminate.SQL,
    "op4_mixing": mixing.SQL.format(docs="documents"),
    "op7_jaccard": jaccard.SQL,
    "op8_neighbours": neighbours.SQL,
    "op9_secrets": secrets.SQL,
}
