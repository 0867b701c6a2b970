"""SQL surface: the text and relevance functions as temporary SQL functions.

``register_sql_functions(spark)`` creates ``ws_trim``, ``clean_text``, ``clean_text_strict``,
``word_count``, ``normalize_key``, ``compact_key``, ``product_oid``, ``token_weight``,
``match_score_norm`` and ``match_score`` (``CREATE TEMPORARY FUNCTION ... RETURN``), built from
the same fixed patterns as the Column versions in ``text.py``. SQL function bodies are inlined
by the analyzer, so plans are identical to the DataFrame ones.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from revidence.functions import text as T


def raw(pattern: str) -> str:
    """Spark SQL raw string literal for a Java regex."""
    if "'" not in pattern:
        return "r'" + pattern + "'"
    if '"' not in pattern:
        return 'r"' + pattern + '"'
    return 'r"' + pattern.replace('\\"', r"\x22").replace('"', r"\x22") + '"'


def plain(s: str) -> str:
    """Spark SQL string literal with \\u escapes for every non-printable or non-ASCII character."""
    out = []
    for ch in s:
        if ch == "'" or ch == "\\" or not (32 <= ord(ch) < 127):
            out.append("\\u%04x" % ord(ch))
        else:
            out.append(ch)
    return "'" + "".join(out) + "'"


def _clean_body(strict: bool) -> str:
    x = "ws_trim(s)"
    x = f"regexp_replace({x}, {raw(T.URL_RE)}, '')"
    x = f"regexp_replace({x}, {raw(T.EMOJI_RE_STRICT if strict else T.EMOJI_RE)}, '')"
    for pat, rep in T.CLEAN_RULES:
        x = f"regexp_replace({x}, {raw(pat)}, {plain(rep)})"
    x = f"regexp_replace({x}, {raw(T.WS + '+')}, ' ')"
    return f"ws_trim({x})"


TOKEN_WEIGHT = ("CASE WHEN {t} RLIKE '^[0-9]+$' THEN 0.1D WHEN {t} RLIKE '^[a-z]*[0-9]+[a-z]*$' THEN 0.2D "
                "WHEN length({t}) <= 2 THEN 0.2D ELSE 1.0D END")


def definitions() -> list[str]:
    toks = "CASE WHEN {n} = '' THEN array() ELSE split({n}, ' ') END"
    # SQL functions cannot be called on lambda variables, so the weight is inlined here
    wsum = "aggregate(transform({a}, t -> " + TOKEN_WEIGHT.format(t="t") + "), 0D, (acc, v) -> acc + v)"
    nt, tt = toks.format(n="nn"), toks.format(n="tn")
    matched = f"filter(array_distinct({nt}), t -> array_contains({tt}, t))"
    cov = f"({wsum.format(a=matched)} / {wsum.format(a=nt)})"
    return [
        f"ws_trim(s STRING) RETURNS STRING RETURN trim(BOTH {plain(T.WS_CHARS)} FROM s)",
        f"clean_text(s STRING) RETURNS STRING RETURN {_clean_body(False)}",
        f"clean_text_strict(s STRING) RETURNS STRING RETURN {_clean_body(True)}",
        f"word_count(s STRING) RETURNS INT RETURN CASE WHEN ws_trim(s) = '' THEN 0 "
        f"ELSE size(split(ws_trim(s), {raw(T.WS + '+')})) END",
        "normalize_key(s STRING) RETURNS STRING RETURN trim(regexp_replace(lower(s), '[^a-z0-9]+', ' '))",
        "compact_key(s STRING) RETURNS STRING RETURN translate(lower(s), ' _', '')",
        "product_oid(s STRING) RETURNS STRING RETURN substring(md5(lower(s)), 1, 24)",
        "token_weight(t STRING) RETURNS DOUBLE RETURN " + TOKEN_WEIGHT.format(t="t"),
        f"match_score_norm(tn STRING, nn STRING) RETURNS DOUBLE RETURN CASE WHEN tn = '' OR nn = '' THEN 0.0D "
        f"WHEN instr(tn, nn) > 0 THEN 1.0D WHEN size({matched}) = 0 THEN 0.0D WHEN {cov} >= 0.75D THEN 0.9D "
        f"WHEN {cov} >= 0.5D THEN 0.7D WHEN {cov} >= 0.3D THEN 0.45D WHEN {cov} > 0D THEN 0.2D ELSE 0.0D END",
        "match_score(text STRING, name STRING) RETURNS DOUBLE RETURN "
        "match_score_norm(normalize_key(text), normalize_key(name))",
    ]


def register_sql_functions(spark: SparkSession) -> list[str]:
    names = []
    for d in definitions():
        spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION " + d)
        names.append(d.split("(", 1)[0])
    return names
