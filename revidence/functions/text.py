"""Scalar text functions (B1-B10, C1-C3) as native Column expressions (no UDFs).

Regex parity: Python's ``\\s`` is Unicode, Java's and RE2's are ASCII. Every pattern below
uses the explicit class ``WS`` (the characters Python treats as whitespace), so Spark and
the DuckDB twins produce the same strings as the reference's Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (patterns that must equal the reference's behaviour)
# ---------------------------------------------------------------------------

WS = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NON_WS = r"[^\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

# The same set as characters (for character-set trims).
WS_RANGES = [(0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
             (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
WS_CHARS = "".join(chr(c) for a, b in WS_RANGES for c in range(a, b + 1))

URL_RE = r"https?://" + NON_WS + r"+|www\." + NON_WS + "+"

# Emoji / symbol ranges deleted by the cleaner, in the reference's order. The last range
# (U+24C2..U+1F251) also covers CJK, kana and Hangul, which the reference therefore deletes.
EMOJI_RANGES = [
    ("1F600", "1F64F"), ("1F300", "1F5FF"), ("1F680", "1F6FF"), ("1F700", "1F77F"),
    ("1F780", "1F7FF"), ("1F800", "1F8FF"), ("1F900", "1F9FF"), ("1FA00", "1FA6F"),
    ("1FA70", "1FAFF"), ("2702", "27B0"), ("24C2", "1F251"),
]
# Strict variant: the last range narrowed to enclosed alphanumerics so CJK text survives.
EMOJI_RANGES_STRICT = EMOJI_RANGES[:-1] + [("24C2", "24C2"), ("1F170", "1F251")]


def _class(ranges) -> str:
    return "[" + "".join(r"\x{%s}-\x{%s}" % (a, b) for a, b in ranges) + "]+"


EMOJI_RE = _class(EMOJI_RANGES)
EMOJI_RE_STRICT = _class(EMOJI_RANGES_STRICT)

# Ordered rewrite rules of the cleaner after URL and emoji removal: (pattern, replacement).
CLEAN_RULES = [
    (r"[\"']", ""),                 # drop double and single quotes
    (r"\\?/", ","),                 # "\/" or "/" -> ","
    (r"(\\n|\n)+", ", "),           # runs of real or literal newlines -> ", "
    (WS + r"*," + WS + r"*", ", "),  # tidy spaces around commas
    (r"," + WS + r"*,+", ", "),     # collapse doubled commas
    (r"^[^a-zA-Z0-9]+", ""),        # strip leading non-ASCII-alnum
]


def ws_trim(c: Column) -> Column:
    """Python ``str.strip()``: trim the full Unicode whitespace set (a character-set trim, no regex)."""
    return F.trim(c, F.lit(WS_CHARS))


def _guarded(x: Column, pattern: str, rep: str, *needles: str) -> Column:
    """regexp_replace only on rows containing one of the literals the pattern needs
    (byte-level ``instr`` is far cheaper than the regex and its string conversion).
    Each guard references ``x`` three times, so guards are used sparingly: nesting many of
    them multiplies the expression tree and defeats code generation."""
    cond = None
    for n in needles:
        t = F.instr(x, n) > 0
        cond = t if cond is None else cond | t
    return F.when(cond, F.regexp_replace(x, pattern, rep)).otherwise(x)


# Literals without which a rule cannot match (rules in CLEAN_RULES order; None = unguarded).
_RULE_GUARDS = [("\"", "'"), ("/",), None, None, None, None]


def clean_text(c: Column, strict_emoji: bool = False) -> Column:
    """B1: the reference cleaner, rule by rule in its order (input is stripped first)."""
    x = ws_trim(c)
    x = _guarded(x, URL_RE, "", "http", "www.")
    x = F.regexp_replace(x, EMOJI_RE_STRICT if strict_emoji else EMOJI_RE, "")
    for (pat, rep), guard in zip(CLEAN_RULES, _RULE_GUARDS):
        x = _guarded(x, pat, rep, *guard) if guard else F.regexp_replace(x, pat, rep)
    x = F.regexp_replace(x, WS + "+", " ")
    return ws_trim(x)


def relevance_form(c: Column) -> Column:
    """``normalize_key(clean_text(c))`` with fewer regex passes.

    Normalisation maps every run of characters outside [a-z0-9] to one space, so the cleaner's
    slash, comma and whitespace rewrites (non-alphanumerics into non-alphanumerics) and its trims
    cannot change the normalised result. The steps that can are kept in order: URL, emoji and quote
    deletion (they join or remove letters), the newline rule (it removes the 'n' of a literal
    backslash-n) and the leading strip (it removes e.g. a leading 'İ', which lowercases to ASCII).
    Equality with the full chain is a property test (tests/test_parity.py).
    """
    x = _guarded(c, URL_RE, "", "http", "www.")
    x = F.regexp_replace(x, EMOJI_RE, "")
    (q_pat, q_rep), _, (n_pat, n_rep) = CLEAN_RULES[0], CLEAN_RULES[1], CLEAN_RULES[2]
    x = _guarded(x, q_pat, q_rep, "\"", "'")
    x = F.regexp_replace(x, n_pat, n_rep)
    x = F.regexp_replace(x, CLEAN_RULES[5][0], CLEAN_RULES[5][1])
    return normalize_key(x)


def word_count(c: Column) -> Column:
    """B2: ``len(text.split())`` with Unicode whitespace."""
    t = ws_trim(c)
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, WS + "+")))


def normalize_key(c: Column) -> Column:
    """Lower, non [a-z0-9] runs -> one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def compact_key(c: Column) -> Column:
    """Lower, remove spaces and underscores."""
    return F.translate(F.lower(c), " _", "")


def product_oid(name: Column) -> Column:
    """First 24 hex characters of md5(lower(name))."""
    return F.substring(F.md5(F.lower(name)), 1, 24)


def slug_id(name: Column) -> Column:
    """Normalised name with '_' for spaces."""
    return F.replace(normalize_key(name), F.lit(" "), F.lit("_"))


def prompt_text(name: Column, text: Column) -> Column:
    """The scorer input."""
    return F.concat(F.lit("Main product: "), name, F.lit(". Review: "), text)


def search_query(name: Column) -> Column:
    """Quoted-name forum query."""
    return F.concat(F.lit('"'), name, F.lit('" review OR experience OR thoughts'))


def url_quote(c: Column) -> Column:
    """Python ``urllib.parse.quote`` (safe='/') from Java's form encoder."""
    e = F.url_encode(c)
    for a, b in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        e = F.replace(e, F.lit(a), F.lit(b))
    return e


# --- relevance (C1-C3) --------------------------------------------------------------------

def token_weight(t: Column) -> Column:
    """Digits 0.1; letters around digits 0.2; length <= 2 0.2; else 1.0."""
    return (F.when(t.rlike("^[0-9]+$"), F.lit(0.1))
            .when(t.rlike("^[a-z]*[0-9]+[a-z]*$"), F.lit(0.2))
            .when(F.length(t) <= 2, F.lit(0.2))
            .otherwise(F.lit(1.0)))


def tokens(norm: Column) -> Column:
    return F.when(norm == "", F.array().cast("array<string>")).otherwise(F.split(norm, " "))


def _wsum(arr: Column) -> Column:
    return F.aggregate(F.transform(arr, token_weight), F.lit(0.0), lambda a, b: a + b)


def _bound(value: Column, then) -> Column:
    """``then(value)`` with the value computed once however often ``then`` mentions it (a lambda variable)."""
    return F.transform(F.array(value), then)[0]


def match_score_norm(text_norm: Column, name_norm: Column, text_tokens: Column | None = None) -> Column:
    """C2 over already-normalised strings.

    1.0 if the name is a substring (mid-word allowed); else weighted token coverage mapped to
    0.9 / 0.7 / 0.45 / 0.2 / 0 at 0.75 / 0.5 / 0.3 / > 0. The matched side is a set, the total
    counts repeated name tokens.

    The two strings, the matched tokens and the coverage are bound once (``_bound``): they are regex passes over the whole
    text, which every mention in a branch or in the lambda over the name's tokens would repeat.
    """
    def score(x: Column) -> Column:
        t, n = x["t"], x["n"]
        name_tok = tokens(n)
        # tokens are parted by single spaces, so a token of the text is one between two spaces
        has = (lambda k: F.array_contains(x["tok"], k)) if text_tokens is not None else (
            lambda k: F.instr(F.concat(F.lit(" "), t, F.lit(" ")), F.concat(F.lit(" "), k, F.lit(" "))) > 0)
        covered = lambda cov: (F.when(cov >= 0.75, F.lit(0.9)).when(cov >= 0.5, F.lit(0.7)).when(cov >= 0.3, F.lit(0.45))
                               .when(cov > 0, F.lit(0.2)).otherwise(F.lit(0.0)))
        return (F.when((t == "") | (n == ""), F.lit(0.0))
                .when(F.instr(t, n) > 0, F.lit(1.0))
                .otherwise(_bound(F.filter(F.array_distinct(name_tok), has), lambda matched: F.when(F.size(matched) == 0, F.lit(0.0))
                                  .otherwise(_bound(_wsum(matched) / _wsum(name_tok), covered)))))
    more = [] if text_tokens is None else [text_tokens.alias("tok")]
    return _bound(F.struct(text_norm.alias("t"), name_norm.alias("n"), *more), score)


def match_score(text: Column, name: Column) -> Column:
    return match_score_norm(normalize_key(text), normalize_key(name))


def relevance(text: Column, name: Column, context: Column | None = None) -> Column:
    """max(score(text), score(context)) when the context is non-empty."""
    s = match_score(text, name)
    if context is None:
        return s
    return F.when(F.coalesce(context, F.lit("")) != "", F.greatest(s, match_score(context, name))).otherwise(s)
