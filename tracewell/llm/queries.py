"""The subpackage's queries, one per operator, and their SQL where SQL can express them."""

from tracewell.llm import chat, codes, covertree, decontaminate, htmltext, language, mixing, packing, phrases, simhash, substrings, urls, warc

QUERIES = {
    "op1_covertree": covertree.op1_covertree,
    "op2_packing": packing.op2_packing,
    "op3_substrings": substrings.op3_substrings,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_language": language.op5_language,
    "pages_language": language.pages_language,
    "op6_html": htmltext.op6_html,
    "op7_simhash": simhash.op7_simhash,
    "op8_urls": urls.op8_urls,
    "op9_chat": chat.op9_chat,
    "op10_warc": warc.op10_warc,
    "op11_mixing": mixing.op11_mixing,
    "op12_phrases": phrases.op12_phrases,
    "op13_codes": codes.op13_codes,
}

SQL = {
    "op1_covertree": covertree.OP1_SQL,
    "op3_substrings": substrings.OP3_SQL,
    "op4_decontaminate": decontaminate.OP4_SQL,
    "op8_urls": urls.OP8_SQL,
    "op9_chat": chat.OP9_SQL,
    "op10_warc": warc.OP10_SQL,
    "op12_phrases": phrases.OP12_SQL,
    "op13_codes": codes.OP13_SQL,
}
