"""DuckDB twins of the bridge views and shared SQL fragments for the oracle queries.

Lists are 1-based in DuckDB; float literals are written in exponent form so DuckDB reads
them as DOUBLE (a plain decimal literal would be DECIMAL and round differently).
"""

from __future__ import annotations

from revidence import dims


def dbl(v: float) -> str:
    return "%.17e" % float(v)


def dbl_list(values) -> str:
    return "([" + ", ".join(dbl(v) for v in values) + "]::DOUBLE[])"


def str_lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def parents_list(taxonomy=None) -> str:
    return "([" + ", ".join("([" + ", ".join(str(t) for t in ps) + "]::INTEGER[])" for ps in dims.parents_of(taxonomy)) + "])"


def values_table(rows, cols: list[str]) -> str:
    def fmt(v):
        if isinstance(v, str):
            return str_lit(v)
        if isinstance(v, float):
            return dbl(v)
        return str(v)
    body = ", ".join("(" + ", ".join(fmt(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS t({', '.join(cols)}))"


def dim_top_sql() -> str:
    return values_table([(i, dims.TOP_LABELS[i], float(dims.TOP_THRESHOLDS[i])) for i in range(dims.N_TOP)],
                        ["top_idx", "top_name", "top_thr"])


def dim_sub_sql() -> str:
    return values_table([(i, dims.SUB_LABELS[i], float(dims.SUB_THRESHOLDS[i]), float(dims.SUB_RELIABILITY[i]))
                         for i in range(dims.N_SUB)], ["sub_idx", "sub_name", "sub_thr", "reliability"])


def taxonomy_sql(taxonomy=None) -> str:
    return values_table(dims.taxonomy_pairs(taxonomy), ["top_idx", "sub_idx"])


def dim_spec_sql() -> str:
    rows = [(t, k, o) for t, keys in dims.TOP_TO_SPECS.items() for o, k in enumerate(keys)]
    return values_table(rows, ["top_idx", "spec_key", "ord"])


V_SCORED = """v_scored AS (
  SELECT vec_id AS review_id,
         CASE WHEN vec_id % 50 = 0 THEN 99 ELSE vec_id % 7 END AS product_id,
         CASE WHEN vec_id % 9 = 0 THEN 0.7::DOUBLE WHEN vec_id % 11 = 0 THEN 0.45::DOUBLE ELSE 1.0::DOUBLE END AS relevance,
         10.0::DOUBLE / (1.0::DOUBLE + exp(-e[64])) AS usefulness,
         list_transform(e[1:9], lambda x: x - CASE WHEN vec_id % 10 = 3 THEN 50.0::DOUBLE ELSE 0.0::DOUBLE END) AS top,
         e[10:38] AS sub,
         list_transform(range(29), lambda s: e[(38 + s) % 64 + 1]) AS comp,
         list_transform(range(29), lambda s: {'neg': e[(20 + s) % 64 + 1], 'pos': e[(45 + s) % 64 + 1]}) AS sent
  FROM (SELECT vec_id, list_transform(embedding, lambda x: 16 * x::DOUBLE) AS e FROM embeddings) b
)"""


def sigmoid(x: str) -> str:
    return f"(1.0::DOUBLE / (1.0::DOUBLE + exp(-({x}))))"


def cells_ctes(source: str = "gok", taxonomy=None) -> str:
    """CTE ``cells``: 29 decoded cells per review of ``source``."""
    top_thr = dbl_list(dims.TOP_THRESHOLDS)
    sub_thr = dbl_list(dims.SUB_THRESHOLDS)
    return f"""fired AS (
  SELECT *, list_filter(range(9), lambda t: {sigmoid('top[t + 1]')} > {top_thr}[t + 1]) AS fired FROM {source}
),
cells0 AS (
  SELECT f.product_id, f.review_id, f.usefulness, s.sub_idx::INTEGER AS sub_idx, len(f.fired) AS n_fired,
         {sigmoid('f.sub[s.sub_idx + 1]')} AS p_sub,
         {sigmoid('f.comp[s.sub_idx + 1]')} AS p_comp,
         (len(f.fired) = 0 OR len(list_intersect(f.fired, {parents_list(taxonomy)}[s.sub_idx + 1])) > 0) AS allowed,
         {sub_thr}[s.sub_idx + 1] AS thr,
         f.sent[s.sub_idx + 1].pos - f.sent[s.sub_idx + 1].neg AS delta
  FROM fired f CROSS JOIN (SELECT unnest(range(29)) AS sub_idx) s
),
cells AS (
  SELECT *, (allowed AND p_sub > thr) AS pred_sub,
         (allowed AND p_sub > thr AND p_comp > {dbl(dims.COMPARISON_THRESHOLD)}) AS pred_comp,
         CASE WHEN delta < 0 THEN -1 ELSE 1 END AS sign,
         {sigmoid('abs(delta)')} / {dbl(dims.SENTIMENT_TEMPERATURE)} AS sconf
  FROM cells0
)"""


def gate_ctes() -> str:
    return f"""gated AS (
  SELECT * FROM v_scored WHERE relevance > {dbl(dims.RELEVANCE_THRESHOLD)} AND usefulness > {dbl(dims.USEFULNESS_GATE)}
),
cnt AS (SELECT product_id, count(*) AS n_gated FROM gated GROUP BY product_id),
gok AS (SELECT g.* FROM gated g JOIN cnt USING (product_id) WHERE cnt.n_gated > {dims.MIN_EVIDENCE})"""


def evidence_ctes(agreement: str = "aggregated") -> str:
    a, b = dbl(dims.CONFIDENCE_ALPHA), dbl(dims.CONFIDENCE_BETA)
    rel = dbl_list(dims.SUB_RELIABILITY)
    if agreement == "aggregated":
        agree = "abs(sgn * sw) / (abs(sgn) * sw + 1e-8)"
    else:
        agree = "abs(ssw) / (sw + 1e-8)"
    return f"""med_c AS (SELECT product_id, median(sconf) AS med_c FROM cells GROUP BY product_id),
med_u AS (SELECT product_id, median(usefulness) AS med_u FROM gok GROUP BY product_id),
wcells AS (
  SELECT c.*, (1 - exp(-(sconf / (med_c + 1e-8)) / {a})) * ln(1 + {b} * (usefulness / (med_u + 1e-8))) AS wn,
         (1 - exp(-sconf / {a})) * ln(1 + {b} * usefulness) AS w
  FROM cells c JOIN med_c USING (product_id) JOIN med_u USING (product_id) WHERE pred_sub
),
agg AS (
  SELECT product_id, sub_idx, count(*) AS n_cells, sum(sign * wn) AS s_num, sum(wn) AS s_den,
         sum(w) AS sw, sum(sign * w) AS ssw, sum(ln(1 + {b} * usefulness)) AS vol_raw,
         sum(pred_comp::INTEGER) AS n_comp
  FROM wcells GROUP BY product_id, sub_idx
),
ev0 AS (
  SELECT *, s_num / (s_den + 1e-8) AS score,
         CASE WHEN s_num / (s_den + 1e-8) > 1e-6 THEN 1 WHEN s_num / (s_den + 1e-8) < -1e-6 THEN -1 ELSE 0 END AS sgn
  FROM agg
),
evidence AS (
  SELECT *, {agree} AS agreement, 1 - exp(-vol_raw / {dbl(dims.CONFIDENCE_GAMMA)}) AS volume,
         100 * pow((0.65 + 0.35 * pow({rel}[sub_idx + 1], 0.8)) * ({agree}) * (1 - exp(-vol_raw / {dbl(dims.CONFIDENCE_GAMMA)})), {dbl(dims.CONFIDENCE_PHI)}) AS confidence
  FROM ev0
)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def core_prefix(agreement: str = "aggregated") -> str:
    return with_(V_SCORED, gate_ctes(), cells_ctes("gok"), evidence_ctes(agreement),
                 f"pp AS (SELECT sub_idx, min(top_idx) AS top_idx FROM {taxonomy_sql()} GROUP BY sub_idx)",
                 f"dtop AS {dim_top_sql()}", f"dsub AS {dim_sub_sql()}")


# --- text functions (twins of revidence.functions.text) -------------------------------------

from revidence.functions import text as _T  # noqa: E402


def rx(x: str, pat: str, rep: str) -> str:
    return f"regexp_replace({x}, {str_lit(pat)}, {str_lit(rep)}, 'g')"


def ws_trim(x: str) -> str:
    chars = " || ".join(f"chr({ord(c)})" for c in _T.WS_CHARS)
    return f"trim({x}, {chars})"


def clean_text(x: str, strict: bool = False) -> str:
    y = ws_trim(x)
    y = rx(y, _T.URL_RE, "")
    y = rx(y, _T.EMOJI_RE_STRICT if strict else _T.EMOJI_RE, "")
    for pat, rep in _T.CLEAN_RULES:
        y = rx(y, pat, rep)
    y = rx(y, _T.WS + "+", " ")
    return ws_trim(y)


def word_count(x: str) -> str:
    t = ws_trim(x)
    return f"(CASE WHEN {t} = '' THEN 0 ELSE len(regexp_split_to_array({t}, {str_lit(_T.WS + '+')})) END)"


def normalize_key(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


def token_weight(t: str) -> str:
    return (f"(CASE WHEN regexp_full_match({t}, '[0-9]+') THEN 0.1::DOUBLE "
            f"WHEN regexp_full_match({t}, '[a-z]*[0-9]+[a-z]*') THEN 0.2::DOUBLE "
            f"WHEN length({t}) <= 2 THEN 0.2::DOUBLE ELSE 1.0::DOUBLE END)")


def toks(n: str) -> str:
    return f"(CASE WHEN {n} = '' THEN []::VARCHAR[] ELSE string_split({n}, ' ') END)"


def match_score_norm(tn: str, nn: str) -> str:
    nt, tt = toks(nn), toks(tn)
    matched_w = (f"list_sum(list_transform(list_filter(range(1, len({nt}) + 1), "
                 f"lambda i: list_position({nt}, {nt}[i]) = i AND list_contains({tt}, {nt}[i])), "
                 f"lambda i: {token_weight(nt + '[i]')}))")
    n_matched = (f"len(list_filter(range(1, len({nt}) + 1), "
                 f"lambda i: list_position({nt}, {nt}[i]) = i AND list_contains({tt}, {nt}[i])))")
    total = f"list_sum(list_transform({nt}, lambda t: {token_weight('t')}))"
    cov = f"(coalesce({matched_w}, 0.0) / {total})"
    return (f"(CASE WHEN {tn} = '' OR {nn} = '' THEN 0.0::DOUBLE WHEN strpos({tn}, {nn}) > 0 THEN 1.0::DOUBLE "
            f"WHEN {n_matched} = 0 THEN 0.0::DOUBLE WHEN {cov} >= 0.75 THEN 0.9::DOUBLE "
            f"WHEN {cov} >= 0.5 THEN 0.7::DOUBLE WHEN {cov} >= 0.3 THEN 0.45::DOUBLE "
            f"WHEN {cov} > 0 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END)")


def raw_text(doc_id: str, text: str) -> str:
    from revidence.sources.bridges import DECORATIONS

    def lit(s):
        out = []
        for ch in s:
            if ord(ch) > 127:
                out.append(f"chr({ord(ch)})")
            else:
                out.append(None)
        if all(o is None for o in out):
            return str_lit(s)
        parts, buf = [], ""
        for ch, o in zip(s, out):
            if o is None:
                buf += ch
            else:
                if buf:
                    parts.append(str_lit(buf))
                    buf = ""
                parts.append(o)
        if buf:
            parts.append(str_lit(buf))
        return " || ".join(parts)
    whens = " ".join(f"WHEN {doc_id} % 8 = {i} THEN {lit(pre) if pre else chr(39)*2} || {text} || {lit(suf) if suf else chr(39)*2}"
                     for i, (pre, suf) in enumerate(DECORATIONS))
    return f"(CASE {whens} END)"


V_REVIEWS = f"""v_reviews AS (
  SELECT source AS product_id, doc_id AS review_id,
         CASE WHEN doc_id % 3 <> 0 THEN 'comment' ELSE 'review' END AS origin, doc_id AS pos,
         {raw_text('doc_id', 'text')} AS raw_text,
         (CASE WHEN doc_id % 3 <> 0 THEN n_chars % 101 END)::BIGINT AS likes
  FROM documents
)"""


def v_products_sql() -> str:
    from revidence.sources.bridges import PRODUCT_NAMES
    return values_table([(f"src{i}", n) for i, n in enumerate(PRODUCT_NAMES)], ["product_id", "name"])


V_CATALOG = """v_catalog AS (
  SELECT p_partkey AS corpus_idx, 'k_' || p_partkey::VARCHAR AS key, left(md5('k_' || p_partkey::VARCHAR), 24) AS oid,
         CASE p_partkey % 8
           WHEN 0 THEN 'Apple iPhone ' || (p_partkey % 17)::VARCHAR || ' Pro Max'
           WHEN 1 THEN 'Apple iPhone ' || (p_partkey % 17)::VARCHAR || ' Pro'
           WHEN 2 THEN 'Apple iPhone ' || (p_partkey % 17)::VARCHAR || ' Plus'
           WHEN 3 THEN 'Apple iPhone ' || (p_partkey % 17)::VARCHAR || ' Mini'
           WHEN 4 THEN 'Samsung Galaxy S' || (p_partkey % 19)::VARCHAR
           WHEN 5 THEN 'Google Pixel ' || (p_partkey % 13)::VARCHAR || 'a'
           WHEN 6 THEN 'Nokia ' || p_name
           ELSE p_name || ' ' || p_brand END AS name
  FROM part
)"""


FLAT_SPECS = """flat_specs AS (
  SELECT p_partkey::VARCHAR AS product_id, 'Battery_Type' AS spec_key, trim(p_type) AS spec_value FROM part
  UNION ALL SELECT p_partkey::VARCHAR, 'Battery_Charging', p_size::VARCHAR || 'W' FROM part
  UNION ALL SELECT p_partkey::VARCHAR, 'Body_Weight', (p_partkey % 150 + 100)::VARCHAR || ' g' FROM part
  UNION ALL SELECT p_partkey::VARCHAR, 'Body_SIM', 'Nano-SIM' FROM part
  UNION ALL SELECT p_partkey::VARCHAR, 'Main_Camera_Single', (p_size % 50)::VARCHAR || ' MP f/1.8' FROM part
  UNION ALL SELECT p_partkey::VARCHAR, 'Platform_OS',
                   CASE WHEN p_partkey % 5 = 3 THEN 'Updated OS' ELSE 'OS ' || (p_partkey % 7)::VARCHAR END FROM part
  UNION ALL SELECT p_partkey::VARCHAR, 'Our_Tests_Battery_Life', 'Endurance ' || (p_partkey % 90)::VARCHAR || 'h'
            FROM part WHERE p_partkey % 5 = 0
  UNION ALL SELECT p_partkey::VARCHAR, 'Launch', 'Announced ' || (p_partkey % 25 + 2000)::VARCHAR
            FROM part WHERE p_partkey % 5 = 2
)"""


def drop_keys_sql() -> str:
    return "(" + ", ".join(str_lit(k) for k in dims.DROP_SPEC_KEYS) + ")"


def sdiv(n: str, d: str) -> str:
    return f"(CASE WHEN ({d}) = 0 THEN 0.0::DOUBLE ELSE ({n})::DOUBLE / ({d}) END)"


def v_labels_sql() -> str:
    return f"""v_labels AS (
  SELECT vec_id AS review_id, t.top_idx, t.sub_idx, ((vec_id + t.sub_idx) % 2)::INTEGER AS y_sent,
         ((vec_id + 2 * t.sub_idx) % 5 = 0)::INTEGER AS y_comp
  FROM embeddings JOIN {taxonomy_sql()} t ON embeddings.label = t.top_idx
  WHERE embeddings.label < 9 AND (vec_id + t.sub_idx) % 3 <> 0
)"""


def eval_prefix(extra: tuple = ()) -> str:
    """CTEs: v_scored, cells over ALL reviews, v_labels, ec (cells + labels)."""
    return with_(V_SCORED, cells_ctes("v_scored"), v_labels_sql(), """ec AS (
  SELECT c.*, (l.review_id IS NOT NULL)::INTEGER AS y, coalesce(l.y_sent, -1) AS y_sent3, coalesce(l.y_comp, 0) AS y_comp,
         CASE WHEN c.delta > 0 THEN 1 WHEN c.delta < 0 THEN 0 ELSE -1 END AS p_sent3,
         CASE WHEN c.pred_sub THEN (CASE WHEN c.delta > 0 THEN 1 WHEN c.delta < 0 THEN 0 ELSE -1 END) ELSE -1 END AS joint
  FROM cells c LEFT JOIN v_labels l ON l.review_id = c.review_id AND l.sub_idx = c.sub_idx
)""", *extra)


V_QUERIES = f"""v_queries AS (
  SELECT corpus_idx AS qid, CASE corpus_idx % 6
    WHEN 0 THEN name
    WHEN 1 THEN regexp_replace({normalize_key('name')}, '^(apple|samsung|google) +', '')
    WHEN 2 THEN substring({normalize_key('name')}, 2, 6)
    WHEN 3 THEN 'zz' || corpus_idx::VARCHAR || 'qq'
    WHEN 4 THEN ''
    ELSE upper(name) || '!!' END AS query
  FROM v_catalog
)"""


def aliases_sql(name: str, key: str, compat: bool = False) -> str:
    from revidence.operators.catalog import BRAND_RE, GALAXY_PIXEL_BRAND_RE
    n = normalize_key(name)
    k = normalize_key(f"coalesce({key}, '')")
    nb = f"regexp_replace({n}, {str_lit(BRAND_RE)}, '')"
    ni = f"trim(replace({n}, 'iphone', ''))"
    if not compat:
        ni = f"trim(regexp_replace({ni}, ' +', ' ', 'g'))"
    num = f"regexp_extract({n}, '(\\d+)', 1)"
    has = lambda s: f"(strpos({n}, '{s}') > 0)"
    base = f"({has('iphone')} AND {num} <> '')"
    pm, pro, plus, mini = has("pro max"), has("pro"), has("plus"), has("mini")
    gp = f"regexp_replace({n}, {str_lit(GALAXY_PIXEL_BRAND_RE)}, '')"
    items = [
        f"CASE WHEN {n} <> '' THEN {n} END", f"CASE WHEN {k} <> '' THEN {k} END",
        f"CASE WHEN {nb} <> '' AND {nb} <> {n} THEN {nb} END",
        f"CASE WHEN {has('iphone')} AND {ni} <> '' THEN {ni} END",
        f"CASE WHEN {base} AND {pm} THEN {num} || ' pro max' END", f"CASE WHEN {base} AND {pm} THEN {num} || 'pm' END",
        f"CASE WHEN {base} AND {pm} THEN 'pro max ' || {num} END",
        f"CASE WHEN {base} AND NOT {pm} AND {pro} THEN {num} || ' pro' END",
        f"CASE WHEN {base} AND NOT {pm} AND {pro} THEN 'pro ' || {num} END",
        f"CASE WHEN {base} AND NOT {pm} AND {pro} THEN {num} || 'p' END",
        f"CASE WHEN {base} AND NOT {pm} AND NOT {pro} AND {plus} THEN {num} || ' plus' END",
        f"CASE WHEN {base} AND NOT {pm} AND NOT {pro} AND {plus} THEN 'plus ' || {num} END",
        f"CASE WHEN {base} AND NOT {pm} AND NOT {pro} AND NOT {plus} AND {mini} THEN {num} || ' mini' END",
        f"CASE WHEN {base} AND NOT {pm} AND NOT {pro} AND NOT {plus} AND {mini} THEN 'mini ' || {num} END",
        f"CASE WHEN ({has('galaxy')} OR {has('pixel')}) AND {gp} <> '' THEN {gp} END",
    ]
    return f"list_sort(list_distinct(list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)))"


CAT_ALIAS = f"""al AS (SELECT corpus_idx, unnest({aliases_sql('name', 'key')}) AS alias FROM v_catalog),
aidx AS (SELECT alias, min(corpus_idx) AS corpus_idx FROM al GROUP BY alias)"""


CONV = """heads AS (SELECT conv_id, arg_min(text, turn) AS t0, min(turn) AS t_min FROM conversations GROUP BY conv_id),
v_posts AS (SELECT conv_id AS post_id, (conv_id % 5 = 0)::BIGINT AS product_id, conv_id AS pos,
                   CASE WHEN conv_id % 3 = 0 THEN t0 ELSE array_to_string(string_split(t0, ' ')[1:8], ' ') END AS title,
                   CASE WHEN conv_id % 3 <> 0 THEN t0 ELSE '' END AS selftext FROM heads),
v_comments AS (SELECT c.conv_id AS post_id, p.product_id, c.turn AS c_pos, c.text AS body,
                      (CASE WHEN c.turn = 5 THEN NULL ELSE c.turn * 3 END)::BIGINT AS ups, p.title
               FROM conversations c JOIN heads h USING (conv_id) JOIN v_posts p ON p.post_id = c.conv_id WHERE c.turn > h.t_min)"""
