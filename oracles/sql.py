"""SQL that computes each registered query's result on the same tables, written independently.

The metric statements pair every model with every duel it plays in and aggregate, which is the
plain definition; the library aggregates the sides of the duels once instead.
"""

from __future__ import annotations

import re

from duelytics import constants as c
from duelytics.derived import CHECK_CATALOGUE, CHECK_DICTIONARIES, NAME_POOL
from duelytics.dictionaries import CONVERSATION_SIDE, Dictionary, DictionarySet, keyword_set
from duelytics.functions.text import stem_pattern
from duelytics.operators import bias, explorer
from duelytics.registry import CATEGORIES, DETAIL_ID, EXPLORED, SAMPLE

W = r"[\p{L}\p{N}_]"
NOT_W = r"[^\p{L}\p{N}_]"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def texts(values) -> str:
    return ", ".join(text(v) for v in values)


def rnd(expr: str, digits: int) -> str:
    return f"(round_even(({expr}) * 1e{digits}, 0) / 1e{digits} + 0.0::double)"


# Derived tables ---------------------------------------------------------------------------

POOL = f"([{texts(NAME_POOL)}])"


def pool(index: str) -> str:
    return f"{POOL}[({index}) % {len(NAME_POOL)} + 1]"


FLAGS = {
    "useful": 2, "creative": 3, "clear_formatting": 5, "incorrect": 7, "superficial": 11,
    "instructions_not_followed": 13,
}
FLAG_SQL = ", ".join(
    f"{'o_orderkey' if s == 'a' else 'o_custkey'} % {n} = 0 AS conv_{flag}_{s}"
    for flag, n in FLAGS.items()
    for s in ("a", "b")
)

CTES: dict[str, str] = {}

CTES["duels"] = f"""
SELECT o_orderkey AS duel_id, {pool('o_orderkey')} AS model_a_name,
  {pool('o_orderkey * 7 + o_custkey')} AS model_b_name,
  CASE WHEN o_custkey % 50 = 0 THEN '' ELSE o_custkey::varchar END AS visitor_id,
  's' || o_custkey::varchar AS session_hash, o_orderdate AS "timestamp",
  coalesce(n, 0) AS conv_turns,
  ta AS total_conv_a_output_tokens, tb AS total_conv_b_output_tokens,
  (ka + n * 0.0000004)::double AS total_conv_a_kwh, kb::double AS total_conv_b_kwh,
  nullif(o_orderkey % 7 * 10, 0)::double AS model_a_total_params,
  nullif(o_custkey % 5 * 10, 0)::double AS model_b_total_params,
  CASE WHEN o_orderstatus = 'P' THEN true WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL
    ELSE false END AS both_equal,
  CASE o_orderstatus WHEN 'F' THEN {pool('o_orderkey')}
    WHEN 'O' THEN {pool('o_orderkey * 7 + o_custkey')} END AS chosen_model_name,
  CASE WHEN o_orderkey % 5 = 0 THEN 'custom' ELSE 'random' END AS mode,
  CASE WHEN o_orderkey % 10 = 0 THEN [{pool('o_orderkey')}, {pool('o_orderkey * 7 + o_custkey')}]
    WHEN o_orderkey % 5 = 0 THEN [{pool('o_orderkey')}] END AS custom_models_selection,
  CASE WHEN p_type IS NOT NULL THEN [p_type, c_mktsegment] END AS categories,
  string_split(p_name, ' ') AS keywords,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN ['fr', 'en'] ELSE ['en'] END
    AS languages,
  repeat(p_name || ' ', n * 3) AS opening_msg, o_orderpriority AS selected_category,
  {FLAG_SQL},
  CASE WHEN o_orderstatus = 'F' THEN '  ' || o_orderpriority || ' ' END AS conv_comments_a,
  CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END AS conv_comments_b
FROM orders
LEFT JOIN (
  SELECT l_orderkey, count(*) AS n, sum(l_quantity::bigint)::bigint AS ta,
    sum(l_quantity::bigint * l_linenumber)::bigint AS tb,
    sum(l_extendedprice::decimal(18, 2)) AS ka,
    sum(l_extendedprice::decimal(18, 2) * l_discount::decimal(4, 2)) AS kb,
    min(l_partkey) AS pk
  FROM lineitem GROUP BY 1
) ON l_orderkey = o_orderkey
LEFT JOIN customer ON c_custkey = o_custkey
LEFT JOIN part ON p_partkey = pk"""

CTES["reactions"] = """
SELECT duel_id AS id, l_linenumber AS msg_rank, visitor_id, session_hash, model_a_name,
  model_b_name, conv_turns,
  CASE WHEN l_linenumber % 2 = 1 THEN 'a' ELSE 'b' END AS model_pos,
  CASE l_returnflag WHEN 'A' THEN true WHEN 'R' THEN false END AS liked,
  l_quantity > 25 AS useful, l_discount > 0.05::double AS creative,
  l_tax > 0.04::double AS clear_formatting, l_discount < 0.02::double AS instructions_not_followed,
  l_tax < 0.02::double AS incorrect, l_quantity < 5 AS superficial
FROM duels JOIN lineitem ON l_orderkey = duel_id"""

CTES["text_duels"] = f"""
SELECT doc_id AS duel_id, {pool('doc_id')} AS model_a_name,
  {pool('doc_id * 7 + n_chars')} AS model_b_name, source, lang, "text",
  ['Musées et patrimoine', 'Sport', 'Théâtre'][doc_id % 3 + 1] AS topic,
  len(string_split("text", chr(10))) AS conv_turns
FROM documents"""

CTES["corpus"] = 'SELECT source AS model, doc_id, lower("text") AS "text" FROM documents'
CTES["artworks"] = 'SELECT "text" AS v FROM documents'
CTES["venues"] = """
SELECT unnest(regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a>', 1)) AS nom,
  regexp_extract(html, '<title>([^<]*)</title>', 1) AS region,
  regexp_extract(html, '&middot; ([^<]*)</footer>', 1) AS kind
FROM pages"""


# Names --------------------------------------------------------------------------------------


def version(name: str) -> str:
    found = f"regexp_extract_all({name}, {text(c.PARAMS_PATTERN)}, 0)"
    return f"array_to_string(list_filter({found}, lambda m: m <> '')[1:2], '-')"


def stem(name: str) -> str:
    bare = f"lower(regexp_replace({name}, {text(c.PARAMS_PATTERN)}, '', 'g'))"
    return f"trim(regexp_replace({bare}, '[-._]+', '-', 'g'), '-.')"


def family(name: str) -> str:
    out = stem(name)
    for pattern, value in c.FAMILY_CORRECTIONS:
        out = f"regexp_replace({out}, {text(pattern)}, {text(value)})"
    return out


def no_junk(*columns: str) -> str:
    tests = [f"NOT starts_with({col}, {text(p)})" for col in columns for p in c.JUNK_PREFIXES]
    return " AND ".join(tests)


def no_bad(*columns: str) -> str:
    return " AND ".join(f"{col} NOT IN ({texts(c.BAD_NAMES)})" for col in columns)


RAW = ("model_a_name", "model_b_name")
JUNK, BAD = no_junk(*RAW), no_bad(*RAW)


def normalized(source: str, where: str = "true", winner: bool = False) -> str:
    chosen = (
        f", {family('chosen_model_name')} AS chosen_base_model, "
        f"{version('chosen_model_name')} AS chosen_version"
        if winner
        else ""
    )
    return f"""
SELECT * FROM (
  SELECT *, trim({family('model_a_name')}, '-') AS base_model_a,
    trim({family('model_b_name')}, '-') AS base_model_b,
    trim({version('model_a_name')}, '-') AS version_a,
    trim({version('model_b_name')}, '-') AS version_b{chosen}
  FROM {source} WHERE conv_turns > 0 AND {where}
) WHERE base_model_a <> '' AND base_model_b <> ''"""


CTES["conv_raw"] = f"""
SELECT * REPLACE (coalesce(nullif(visitor_id, ''), session_hash) AS visitor_id)
FROM duels WHERE {JUNK} AND {BAD}"""
CTES["conv"] = normalized("conv_raw")
CTES["votes"] = normalized("duels", winner=True)
CTES["arena_rows"] = normalized("duels", JUNK, winner=True)
CTES["arena"] = """
SELECT *, row_number() OVER (
  ORDER BY "timestamp"::date, substr(md5(duel_id::varchar), 1, 3), duel_id) - 1 AS arena_id
FROM arena_rows"""
CTES["react_all"] = normalized("reactions")
CTES["react"] = """
SELECT * EXCLUDE (msg_rank, visitor_id, session_hash, conv_turns),
  CASE model_pos WHEN 'a' THEN base_model_a WHEN 'b' THEN base_model_b END AS model,
  CASE model_pos WHEN 'a' THEN version_a WHEN 'b' THEN version_b END AS version
FROM react_all"""
CTES["text_conv"] = f"{normalized('text_duels', JUNK)} AND lang = 'fr'"


# Models and the duels they play in ------------------------------------------------------------


def models(source: str) -> str:
    return f"""
SELECT DISTINCT f AS family, v AS version FROM (
  SELECT base_model_a AS f, version_a AS v FROM {source}
  UNION ALL SELECT base_model_b, version_b FROM {source}
  UNION ALL SELECT base_model_a, 'Tous' FROM {source}
  UNION ALL SELECT base_model_b, 'Tous' FROM {source}
) WHERE trim(v) <> ''"""


def played(models_table: str, source: str) -> str:
    on = " OR ".join(
        f"(d.base_model_{s} = m.family AND (m.version = 'Tous' OR d.version_{s} = m.version))"
        for s in ("a", "b")
    )
    flags = ", ".join(
        f"(d.base_model_{s} = m.family AND (m.version = 'Tous' OR d.version_{s} = m.version))"
        f" AS on_{s}"
        for s in ("a", "b")
    )
    return f"SELECT m.family, m.version, d.*, {flags} FROM {models_table} m JOIN {source} d ON {on}"


CTES["models"] = models("conv")
CTES["vote_models"] = models("votes")
CTES["played"] = played("models", "conv")
CTES["voted"] = played("vote_models", "votes")
CTES["react_models"] = """
SELECT model AS family, version, * EXCLUDE (version) FROM react
WHERE model IS NOT NULL AND trim(version) <> ''
UNION ALL SELECT model, 'Tous', * EXCLUDE (version) FROM react WHERE model IS NOT NULL"""


def own(a: str, b: str) -> str:
    return f"coalesce(sum(CASE WHEN on_a THEN {a} END), 0) + coalesce(sum(CASE WHEN on_b THEN {b} END), 0)"


def first(a: str, b: str) -> str:
    return f"CASE WHEN base_model_a = family THEN {a} ELSE {b} END"


KWH = tuple(f"total_conv_{s}_kwh::varchar::decimal(38, 18)" for s in ("a", "b"))
TOK = ("total_conv_a_output_tokens", "total_conv_b_output_tokens")


def mean(expr: str) -> str:
    return f"sum({expr})::double / count({expr})"


def share(condition: str, total: str = "count(*)") -> str:
    return f"(count(*) FILTER (WHERE {condition}))::double / {total} * 100"


PICKED = (
    "mode = 'custom' AND coalesce(contains(lower(array_to_string(custom_models_selection, ' ')),"
    " lower(family)), false)"
)
METRIC_PARTS = {
    "conversations": "count(*)",
    "kwh_total": rnd(f"({own(*KWH)})::double", 2),
    "kwh_avg": rnd(mean(first(*KWH)), 3),
    "tokens_total": f"({own(*TOK)})::bigint",
    "tokens_avg": rnd(mean(first(*TOK)), 3),
    "carbon_kg": rnd(f"{rnd(f'({own(*KWH)})::double', 2)} * {c.CARBON_KG_PER_KWH}::double", 2),
    "carbon_g_per_conv": rnd(
        rnd(f"{rnd(f'({own(*KWH)})::double', 2)} * {c.CARBON_KG_PER_KWH}::double", 2)
        + " / count(*) * 1000",
        3,
    ),
    "turns_total": "coalesce(sum(conv_turns), 0)::bigint",
    "turns_avg": rnd(
        f"({own('conv_turns', 'conv_turns')})::double / (count(*) FILTER (WHERE on_a)"
        " + count(*) FILTER (WHERE on_b))",
        2,
    ),
    "deep_engagement": rnd(share("conv_turns > 2"), 1),
    "pick_rate": rnd(share(PICKED, "(SELECT count(*) FROM conv WHERE mode = 'custom')"), 1),
    "visitors": "count(DISTINCT visitor_id) + max((visitor_id IS NULL)::int)",
}
METRIC_PARTS["pick_rate_delta"] = rnd(f"{METRIC_PARTS['pick_rate']} - {c.MEAN_PICK_RATE}::double", 1)
WON = "chosen_base_model = family AND NOT coalesce(both_equal, false)"


def metric(*names: str) -> str:
    columns = ", ".join(f"{METRIC_PARTS[n]} AS {n}" for n in names)
    return f"SELECT family, version, {columns} FROM played GROUP BY family, version"


CTES["param_size"] = """
SELECT family, version, value AS total_params, value::varchar || ' Mds params' AS label FROM (
  SELECT family, version, value,
    row_number() OVER (PARTITION BY family, version ORDER BY count(*) DESC, value) AS r
  FROM (
    SELECT family, version, unnest([
      CASE WHEN base_model_a = family THEN model_a_total_params END,
      CASE WHEN base_model_b = family THEN model_b_total_params END]) AS value
    FROM played WHERE version <> 'Tous'
  ) WHERE value IS NOT NULL GROUP BY 1, 2, 3
) WHERE r = 1"""
CTES["winrate"] = f"""
SELECT family, version, votes, wins, draws, {rnd('(wins + draws * 0.5::double) / votes * 100', 2)}
  AS winrate
FROM (SELECT family, version, count(*) AS votes, count(*) FILTER (WHERE {WON}) AS wins,
  count(*) FILTER (WHERE both_equal) AS draws FROM voted GROUP BY 1, 2)"""
TAGS = [
    "useful", "creative", "clear_formatting", "instructions_not_followed", "incorrect",
    "superficial",
]


def flag_mean(name: str) -> str:
    return f"sum({name}::int)::double / count({name})"


CTES["tag_means"] = f"""
SELECT family, version, count(*) AS reactions,
  {rnd(flag_mean('liked') + ' * 100', 2)} AS satisfaction,
  {', '.join(f'{flag_mean(t)} AS {t}_mean' for t in TAGS)}
FROM react_models GROUP BY 1, 2"""
CTES["bench"] = f"""
SELECT {', '.join(f'(SELECT {flag_mean(t)} FROM react) AS {t}' for t in TAGS)},
  (SELECT ({mean(TOK[0])} + {mean(TOK[1])}) / 2 FROM conv) AS tokens,
  (SELECT {mean('conv_turns')} FROM conv) AS turns"""
CTES["price_rows"] = f"""
SELECT p_partkey AS position, lower(p_brand) || '/' || lower(name) AS id,
  CASE WHEN starts_with(name, 'phi') THEN '0' WHEN starts_with(name, 'yi') THEN 'abc'
    WHEN NOT starts_with(name, 'glm')
      THEN '0.0000' || round(p_retailprice * 100)::bigint::varchar END AS completion
FROM (SELECT *, {pool('p_partkey')} AS name FROM part)"""
CTES["price"] = f"""
SELECT family, version,
  CASE WHEN version = 'Tous' THEN coalesce({rnd('sum(value) / count(value)', 6)}, 0)
    ELSE coalesce(arg_min([value], position)[1], 0) END AS price,
  version = 'Tous' AND count(value) > 0 AND coalesce(max(value <> 0), false) = false AS is_free
FROM (SELECT m.*, position, try_cast(coalesce(completion, '0') AS double) AS value
  FROM models m JOIN price_rows ON contains(id, lower(family))
    AND (version = 'Tous' OR contains(id, lower(version))))
GROUP BY 1, 2"""

CTES["topics"] = """
SELECT *, row_number() OVER (PARTITION BY family, version ORDER BY n DESC, category, keyword)::int
  AS rank
FROM (
  SELECT family, version, lower(category) AS category, lower(keyword) AS keyword, count(*) AS n
  FROM (SELECT *, unnest(keywords) AS keyword FROM (
    SELECT family, version, keywords, unnest(categories) AS category
    FROM played WHERE list_contains(languages, 'fr')))
  WHERE category IS NOT NULL AND keyword IS NOT NULL GROUP BY 1, 2, 3, 4)
QUALIFY rank <= 50"""


def both_sides(source: str, columns: str, extra: str) -> str:
    parts = [
        f"SELECT family, version, {columns}, {extra.format(s=s)} FROM {source} WHERE on_{s}"
        for s in ("a", "b")
    ]
    return " UNION ALL ".join(parts)


CTES["monthly_tokens"] = f"""
SELECT *, tokens::double / sum(tokens) OVER (PARTITION BY family, version)::double * 100
  AS frequency
FROM (SELECT family, version, strftime("timestamp", '%Y-%m') AS month,
  coalesce(sum(tokens), 0)::bigint AS tokens
  FROM ({both_sides('played', '"timestamp"', 'total_conv_{s}_output_tokens AS tokens')})
  GROUP BY 1, 2, 3)
QUALIFY sum(tokens) OVER (PARTITION BY family, version) <> 0"""
CTES["monthly_wins"] = f"""
SELECT family, version, strftime("timestamp", '%Y-%m') AS month,
  {rnd("sum(score) / count(*) * 100", 2)} AS winrate
FROM ({both_sides('voted', '"timestamp"', '''CASE WHEN both_equal THEN 0.5::double
  WHEN chosen_base_model = family THEN 1.0::double ELSE 0.0::double END AS score, '{s}' AS s''')})
GROUP BY 1, 2, 3"""

# Texts ----------------------------------------------------------------------------------------


def doubled(value: str) -> str:
    """Every separator twice, so that neighbouring hits do not share one."""
    return f"regexp_replace({value}, {text('(' + NOT_W + ')')}, '\\1\\1', 'g')"


def pattern(keywords) -> str:
    def escaped(keyword: str) -> str:
        return re.sub(r"(\W)", r"\\\1\\\1", keyword).replace("\\ ", " ")

    words = "|".join(escaped(k) for k in sorted(keywords, key=len, reverse=True))
    return text(f"(?:^|{NOT_W})(?:{words})(?:$|{NOT_W})")


def cells(dictionaries: DictionarySet):
    for name, categories in dictionaries.items():
        for rank, (category, keywords) in enumerate(categories.items()):
            yield name, category, rank, keywords


def hits(dictionaries: DictionarySet) -> str:
    sums = ", ".join(
        f"sum(len(regexp_extract_all(t, {pattern(k)}))) AS c{i}"
        for i, (*_, k) in enumerate(cells(dictionaries))
    )
    rows = " UNION ALL ".join(
        f"SELECT model, {text(name)} AS dict, {text(category)} AS category, {rank} AS rank,"
        f" c{i}::bigint AS hits FROM s"
        for i, (name, category, rank, _) in enumerate(cells(dictionaries))
    )
    return (
        f'WITH s AS (SELECT model, {sums} FROM (SELECT model, {doubled(chr(34) + "text" + chr(34))}'
        f" AS t FROM corpus) GROUP BY model) {rows}"
    )


def clean(column: str) -> str:
    return f"nullif(lower(trim({column}, {text(c.WHITESPACE)})), '')"


def reference_hits(name: str, dictionary: Dictionary, table: str, column: str) -> str:
    rows = " UNION ALL ".join(
        f"SELECT {text(name)} AS dict, {text(category)} AS category, {rank} AS rank,"
        f" count(*) FILTER (WHERE regexp_matches(t, {pattern(keywords)})) AS hits FROM s"
        for rank, (category, keywords) in enumerate(dictionary.items())
    )
    return f"WITH s AS (SELECT {doubled(clean(column))} AS t FROM {table}) {rows}"


def percent(source: str, keys: str = "") -> str:
    by = f"{keys}, " if keys else ""
    value = f"hits::double / greatest(sum(hits) OVER (PARTITION BY {by}dict), 1) * 100"
    return f"SELECT {by}dict, category, rank, {rnd(value, 1)} AS pct FROM {source}"


CTES["hits"] = hits(CHECK_DICTIONARIES)
REFERENCES = {
    "ref_periods": ("periods", "artworks", "v"),
    "ref_domains": ("domains", "artworks", "v"),
    "ref_regions": ("regions", "venues", "region"),
    "ref_types": ("types", "venues", "kind"),
}
for key, (name, table, column) in REFERENCES.items():
    CTES[key] = reference_hits(name, CHECK_CATALOGUE[name], table, column)
CTES["ref_hits"] = " UNION ALL ".join(f"SELECT * FROM {key}" for key in REFERENCES)
CTES["ref_pct"] = percent("ref_hits")
CTES["ia_pct"] = percent("hits", "model")
CTES["pairs"] = """
SELECT dict, category, model, i.rank, i.pct AS ia, r.pct AS ref
FROM ia_pct i JOIN ref_pct r USING (dict, category)"""
CTES["artists"] = f"""
SELECT name, count(*) AS n FROM (
  SELECT trim(unnest(regexp_split_to_array({clean('v')}, '[;,/]')), {text(c.WHITESPACE)}) AS name
  FROM artworks) WHERE length(name) > 5 GROUP BY 1 ORDER BY n DESC, name LIMIT {c.MAX_NAMES}"""
CTES["places"] = f"""
SELECT {clean('nom')} AS name, count(*) AS n FROM venues WHERE length({clean('nom')}) > 6
GROUP BY 1 ORDER BY n DESC, name LIMIT {c.MAX_NAMES}"""


def coverage(names: str, factor: float) -> str:
    value = f"least(matched / greatest((SELECT count(*) FROM {names}) * {factor}::double, 1), 100)"
    return f"""
SELECT model, matched, {rnd(value, 1)} AS coverage FROM (
  SELECT model, count(name) AS matched FROM (SELECT DISTINCT model FROM corpus) LEFT JOIN (
    SELECT DISTINCT model, name FROM corpus JOIN {names} ON contains("text", name)) USING (model)
  GROUP BY 1)"""


CTES["cover_artists"] = coverage("artists", c.ARTIST_FACTOR)
CTES["cover_places"] = coverage("places", c.VENUE_FACTOR)
CTES["mae"] = """
SELECT model, dict, sum(abs(ia - ref)::decimal(10, 1))::double / count(*) AS mae
FROM pairs GROUP BY 1, 2"""


def score(dicts: tuple[str, str], scale: float, name: str) -> str:
    parts = " + ".join(f"max(mae) FILTER (WHERE dict = {text(d)})" for d in dicts)
    value = rnd(f"least(({parts}) * {scale}::double, 100)", 1)
    return f"SELECT model, {value} AS {name} FROM mae GROUP BY 1"


CTES["score_artworks"] = score(("periods", "domains"), c.ARTWORK_SCALE, "artworks_score")
CTES["score_venues"] = score(("regions", "types"), c.VENUE_SCALE, "venues_score")
CTES["measures"] = """
SELECT model, artworks_score, a.coverage AS artworks_coverage, venues_score,
  v.coverage AS venues_coverage
FROM score_artworks JOIN score_venues USING (model) JOIN cover_artists a USING (model)
JOIN cover_places v USING (model)"""
GAP = rnd("ia - ref", 1)
CTES["map_rows"] = f"""
SELECT model, dict, category, rank, CASE WHEN dict = 'domains' THEN {GAP} ELSE ia END AS ia,
  CASE WHEN dict <> 'domains' THEN ref END AS ref FROM pairs"""

# TF-IDF -----------------------------------------------------------------------------------------

CTES["terms"] = f"""
SELECT model, term, count(*) AS tf FROM (
  SELECT model, unnest(list_concat(w, list_transform(range(1, len(w)),
    lambda i: w[i] || ' ' || w[i + 1]))) AS term
  FROM (SELECT model, regexp_extract_all("text", {text(W + '{2,}')}) AS w FROM corpus))
GROUP BY 1, 2"""
CTES["vocabulary"] = f"""
SELECT term, count(*) AS df, sum(tf)::bigint AS total,
  (SELECT count(DISTINCT model) FROM corpus) AS models
FROM terms GROUP BY 1
HAVING df >= {c.TFIDF_MIN_DF}
  AND df <= {c.TFIDF_MAX_DF}::double * (SELECT count(DISTINCT model) FROM corpus)
ORDER BY total DESC, term LIMIT {c.TFIDF_MAX_FEATURES}"""
CTES["weights"] = """
SELECT model, term, tf, df, raw / sqrt(sum(raw * raw) OVER (PARTITION BY model)) AS weight
FROM (SELECT *, tf * (ln((models + 1)::double / (df + 1)) + 1.0::double) AS raw
  FROM terms JOIN vocabulary USING (term))"""
KEYWORDS = texts(keyword_set(CHECK_DICTIONARIES))
CTES["discriminants"] = f"""
SELECT model, term, weight,
  row_number() OVER (PARTITION BY model ORDER BY weight DESC, term)::int AS rank
FROM weights WHERE term IN ({KEYWORDS}) QUALIFY rank <= {c.TOP_DISCRIMINANTS}"""
CTES["communs"] = f"""
SELECT model, term, row_number() OVER (PARTITION BY model ORDER BY term)::int AS rank
FROM (SELECT DISTINCT model FROM corpus) m, vocabulary v
WHERE term IN ({KEYWORDS})
  AND NOT EXISTS (FROM terms t WHERE t.model = m.model AND t.term = v.term)
QUALIFY rank <= {c.TOP_COMMUNS}"""


def listed(separator: str, before: str = "", quote: str = "", after: str = "") -> str:
    def part(table: str) -> str:
        joined = f"string_agg({text(quote)} || term || {text(quote)}, {text(separator)} ORDER BY rank)"
        return (
            f"{text(before)} || coalesce((SELECT {joined} FROM {table} x"
            f" WHERE x.model = m.model), '') || {text(after)}"
        )

    return (
        f"SELECT model, {part('discriminants')} AS discriminants, {part('communs')} AS communs"
        " FROM (SELECT DISTINCT model FROM corpus) m"
    )


CTES["term_lists"] = listed("|")
CTES["term_json"] = listed(",", "[", '"', "]")


def json_map(name: str) -> str:
    value = (
        "ia::varchar"
        if name == "domains"
        else "'{\"ia\":' || ia::varchar || ',\"ref\":' || ref::varchar || '}'"
    )
    entry = f"'\"' || category || '\":' || {value}"
    return (
        f"'{{' || string_agg({entry}, ',' ORDER BY rank) FILTER (WHERE dict = {text(name)}) || '}}'"
        f" AS {bias.STORED[name]}"
    )


CTES["maps"] = f"""
SELECT model, {', '.join(json_map(n) for n in ('periods', 'domains', 'regions', 'types'))}
FROM map_rows GROUP BY 1"""
CTES["stored"] = f"""
SELECT model, {', '.join(f'{m} AS {bias.STORED[m]}' for m in bias.MEASURES)},
  {', '.join(bias.STORED[n] for n in ('periods', 'domains', 'regions', 'types'))},
  discriminants AS tfidf_discriminants, communs AS tfidf_communs
FROM measures JOIN maps USING (model) JOIN term_json USING (model)"""


def ia_of(name: str, category: str) -> str:
    return (
        f"coalesce((SELECT ia FROM pairs p WHERE p.model = m.model AND dict = {text(name)}"
        f" AND category = {text(category)}), 0)"
    )


def badge(condition: str, label: str, otherwise: str | None = None) -> str:
    last = f" ELSE {text(otherwise)}" if otherwise else ""
    return f"CASE WHEN {condition} THEN {text(label)}{last} END"


CTES["badges"] = f"""
SELECT model, array_to_string(list_filter([
    {badge(ia_of('periods', bias.MIDDLE_AGES[0]) + ' > 50', bias.MIDDLE_AGES[2])},
    {badge(ia_of('periods', bias.MODERN_ART[0]) + ' < 15', bias.MODERN_ART[2])},
    {badge('artworks_score >= 35', bias.HISTORY[1], bias.HISTORY[2])}
  ], lambda x: x IS NOT NULL), '|') AS artworks_badges,
  coalesce(nullif(array_to_string(list_filter([
    {badge(ia_of('regions', bias.CAPITAL[0]) + ' > 25', bias.CAPITAL[2])},
    {badge(ia_of('types', bias.STAGE[0]) + ' > 20', bias.STAGE[2])},
    {badge('venues_score >= 40', bias.REGIONS_HIDDEN[1])}
  ], lambda x: x IS NOT NULL), '|'), ''), {text(bias.NO_BADGE)}) AS venues_badges
FROM measures m"""
CTES["means"] = "SELECT " + ", ".join(
    f"{rnd(f'sum({m}::decimal(12, 1))::double / count({m})', 2)} AS {m}" for m in bias.MEASURES
) + " FROM measures"


def gap_class(limit: float) -> str:
    return (
        f"CASE WHEN {GAP} > {limit}::double THEN 'over' WHEN {GAP} < -{limit}::double THEN 'under'"
        " ELSE 'neutral' END"
    )


def grade(name: str) -> str:
    good, fair = c.COVERAGE_GRADES if name.endswith("coverage") else c.SCORE_GRADES
    sign = ">=" if name.endswith("coverage") else "<="
    return (
        f"CASE WHEN {name} {sign} {good} THEN 'green' WHEN {name} {sign} {fair} THEN 'amber'"
        f" ELSE 'red' END AS {name}_grade"
    )


# Explorer -----------------------------------------------------------------------------------------

KEYS = (
    "duel_id, base_model_a, version_a, base_model_b, version_b, chosen_base_model, both_equal,"
    " selected_category, conv_turns"
)
VERDICT = (
    "CASE WHEN both_equal THEN 'equal' WHEN chosen_base_model = base_model_a THEN 'a'"
    " WHEN chosen_base_model = base_model_b THEN 'b' ELSE 'none' END"
)
MESSAGE = f"trim(coalesce(opening_msg, ''), {text(c.WHITESPACE)})"
M1, V1, M2, V2 = (text(EXPLORED[k]) for k in ("m1", "v1", "m2", "v2"))


def on_side(model: str, ver: str) -> str:
    return " OR ".join(f"(base_model_{s} = {model} AND version_{s} = {ver})" for s in ("a", "b"))


def feedback(names: dict[str, str], side: str) -> str:
    items = ", ".join(badge(f"conv_{flag}_{side}", label) for flag, label in names.items())
    return f"array_to_string(list_filter([{items}], lambda x: x IS NOT NULL), '|')"


LISTED = f"base_model_a = {M1} OR base_model_b = {M1}"
ASSISTANT = "string_split(\"text\", '. ')"
USERS = 'string_split("text", chr(10))'


def every_second(values: str, start: int) -> str:
    return f"list_filter({values}, lambda x, i: i % 2 = {start})"


CTES["string_items"] = """
SELECT duel_id, CASE WHEN json_valid(t) AND duel_id % 10 <> 3 THEN t END AS t FROM (
  SELECT duel_id, replace('[' || array_to_string(list_transform(string_split("text", chr(10)),
    lambda x: '{''role'': ''user'', ''content'': ''' || x || '''}'), ', ') || ']', '''', '"') AS t
  FROM text_duels)"""

# Statements -----------------------------------------------------------------------------------------


def statements() -> dict[str, str]:
    out = {
        "src_clean": (
            "SELECT base_model_a, version_b, chosen_base_model, both_equal, conv_turns FROM votes"
        ),
        "src_artworks": """SELECT v AS "Auteur", 'x' AS "Region" FROM artworks""",
        "src_venues": (
            'SELECT nom AS "Nom", kind AS "Type_equipement", region AS "Region",'
            """ 'Paris' AS "Commune" FROM venues"""
        ),
        "sink_parquet": (
            'SELECT duel_id, visitor_id, base_model_a, version_a, "timestamp", conv_turns FROM conv'
        ),
        "src_guard": "SELECT * FROM conversations",
        "src_parquet": "SELECT * FROM events",
        "src_prices": (
            "SELECT (row_number() OVER (ORDER BY p_partkey) - 1)::int AS position, lower(p_brand) || '/' ||"
            f" {pool('p_partkey')} AS id, completion FROM part JOIN price_rows ON position = p_partkey"
        ),
        "clean_junk_names": f"SELECT duel_id, model_a_name, model_b_name FROM duels WHERE {JUNK}",
        "clean_bad_names": (
            f"SELECT duel_id, model_a_name, model_b_name FROM duels WHERE {JUNK} AND {BAD}"
        ),
        "clean_visitor": (
            "SELECT duel_id, coalesce(nullif(visitor_id, ''), session_hash) AS visitor_id"
            " FROM duels"
        ),
        "clean_turns": "SELECT duel_id, conv_turns FROM duels WHERE conv_turns > 0",
        "model_version": (
            f"SELECT duel_id, model_a_name AS name, trim({version('model_a_name')}, '-') AS version"
            " FROM duels"
        ),
        "model_family": (
            f"SELECT duel_id, model_a_name AS name, {stem('model_a_name')} AS stem FROM duels"
        ),
        "family_corrections": (
            f"SELECT duel_id, model_a_name AS name, trim({family('model_a_name')}, '-') AS family"
            " FROM duels"
        ),
        "family_required": (
            f"SELECT * FROM (SELECT duel_id, trim({family('model_a_name')}, '-') AS base_model_a,"
            f" trim({family('model_b_name')}, '-') AS base_model_b FROM duels)"
            " WHERE base_model_a <> '' AND base_model_b <> ''"
        ),
        "winner_normalize": (
            f"SELECT duel_id, chosen_model_name, {family('chosen_model_name')} AS"
            f" chosen_base_model, {version('chosen_model_name')} AS chosen_version FROM duels"
        ),
        "reaction_side": (
            "SELECT id, msg_rank, model_pos,"
            " CASE model_pos WHEN 'a' THEN base_model_a ELSE base_model_b END AS model,"
            " CASE model_pos WHEN 'a' THEN version_a ELSE version_b END AS version FROM react_all"
        ),
        "prune_reactions": (
            "SELECT id, model_a_name, model_b_name, model_pos, liked, useful, creative,"
            " clear_formatting, instructions_not_followed, incorrect, superficial FROM reactions"
        ),
        "prune_conversations": (
            "SELECT duel_id, visitor_id, model_a_name, conv_turns, mode, opening_msg FROM duels"
        ),
        "prune_votes": (
            "SELECT model_a_name, model_b_name, chosen_model_name, session_hash, conv_turns"
            " FROM duels"
        ),
        "arena_project": (
            "SELECT duel_id, base_model_a, version_a, chosen_version, conv_useful_a,"
            " conv_superficial_b, opening_msg FROM arena_rows"
        ),
        "arena_row_id": (
            'SELECT duel_id, "timestamp", row_number() OVER (ORDER BY "timestamp"::date,'
            " substr(md5(duel_id::varchar), 1, 3), duel_id) - 1 AS arena_id FROM duels"
        ),
        "bias_project": (
            'SELECT duel_id, base_model_a, base_model_b, visitor_id, "timestamp", opening_msg'
            " FROM arena_rows WHERE list_contains(languages, 'fr')"
        ),
        "build_react": "SELECT * FROM react",
        "build_conv": (
            "SELECT duel_id, visitor_id, base_model_a, version_a, base_model_b, version_b,"
            " conv_turns, total_conv_a_kwh, total_conv_b_kwh, total_conv_b_output_tokens FROM conv"
        ),
        "build_votes": (
            "SELECT base_model_a, version_a, base_model_b, version_b, chosen_base_model,"
            ' chosen_version, both_equal, "timestamp" FROM votes'
        ),
        "build_arena": (
            "SELECT arena_id, duel_id, base_model_a, version_a, base_model_b, version_b,"
            " chosen_base_model, both_equal, selected_category FROM arena"
        ),
        "build_bias_conv": (
            'SELECT duel_id, base_model_a, base_model_b, "text" AS opening_msg, source AS'
            " visitor_id FROM text_conv"
        ),
        # Metrics
        "model_structure": (
            "SELECT family, v AS version FROM (SELECT DISTINCT family FROM models) LEFT JOIN"
            " (SELECT family, version AS v FROM models WHERE version <> 'Tous') USING (family)"
        ),
        "home_kpis": (
            "SELECT (SELECT count(*) FROM conv) AS conversations,"
            " (SELECT count(DISTINCT family) FROM models) AS families"
        ),
        "conv_count": metric("conversations"),
        "vote_count": (
            "SELECT family, version, count(*) AS conversations FROM voted GROUP BY 1, 2"
        ),
        "param_size": "SELECT * FROM param_size",
        "audience": metric("visitors"),
        "audience_sketch": f"SELECT *, true AS close FROM ({metric('visitors')})",
        "winrate": "SELECT * FROM winrate",
        "ranking": (
            "SELECT *, (n - position + 1)::double / n AS progress FROM (SELECT family, winrate,"
            " row_number() OVER (ORDER BY winrate DESC, family) AS position, count(*) OVER () AS n"
            " FROM winrate WHERE version = 'Tous' AND family IN (SELECT family FROM models))"
        ),
        "satisfaction": "SELECT family, version, satisfaction FROM tag_means",
        "reaction_count": "SELECT family, version, reactions FROM tag_means",
        "energy_total": metric("kwh_total"),
        "energy_avg": metric("kwh_avg"),
        "tokens_total": metric("tokens_total"),
        "tokens_avg": metric("tokens_avg"),
        "carbon": metric("carbon_kg", "carbon_g_per_conv"),
        "price_per_token": "SELECT * FROM price",
        "estimated_cost": (
            f"SELECT family, version, price, is_free, tokens_total,"
            f" {rnd('price * tokens_total', 2)} AS cost"
            f" FROM ({metric('tokens_total')}) LEFT JOIN price USING (family, version)"
        ),
        "turns_total": metric("turns_total"),
        "turns_avg": metric("turns_avg"),
        "pick_rate": metric("pick_rate"),
        "pick_rate_delta": metric("pick_rate_delta"),
        "deep_engagement": metric("deep_engagement"),
        "benchmarks_global": "SELECT * FROM bench",
        "model_tag_means": (
            f"SELECT family, version, {', '.join(t + '_mean' for t in TAGS)} FROM tag_means"
        ),
        "model_badges": badge_statement(),
        "model_metrics": (
            f"SELECT * FROM ({metric(*METRIC_PARTS)}) LEFT JOIN winrate USING (family, version)"
            " LEFT JOIN param_size USING (family, version)"
        ),
        # Trends
        "topic_pairs": "SELECT * FROM topics",
        "topic_top_categories": (
            "SELECT * FROM topics JOIN (SELECT family, version, category FROM topics"
            " GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY family, version"
            " ORDER BY sum(n) DESC, category) <= 5) USING (family, version, category)"
        ),
        "tokens_monthly_share": "SELECT * FROM monthly_tokens",
        "winrate_monthly": "SELECT * FROM monthly_wins",
        "trend_join": (
            "SELECT * FROM monthly_tokens JOIN monthly_wins USING (family, version, month)"
        ),
        # Corpus
        "cultural_filter": (
            'SELECT duel_id, "text" AS opening_msg FROM text_duels WHERE'
            f" regexp_matches(source || ' ' || topic, {text(stem_pattern().replace('iu', 'i'))}) OR"
            f" regexp_matches(lower(\"text\"), {text(stem_pattern().replace('iu', 'i'))})"
        ),
        "conv_text": (
            'SELECT duel_id, lower(replace("text", chr(10), \' \')) AS text_a,'
            " lower(replace(\"text\", '. ', ' ')) AS text_b FROM text_duels"
        ),
        "model_docs": (
            "SELECT * FROM (SELECT duel_id AS doc_id, base_model_a AS model, 'a' AS side,"
            ' lower(replace("text", chr(10), \' \')) AS "text" FROM text_conv UNION ALL'
            " SELECT duel_id, base_model_b, 'b', lower(replace(\"text\", '. ', ' ')) FROM text_conv)"
            f" WHERE trim(\"text\", {text(c.WHITESPACE)}) <> ''"
        ),
        "sample_docs": (
            "SELECT * FROM corpus QUALIFY row_number() OVER (PARTITION BY model ORDER BY"
            f" md5(doc_id::varchar || '{c.SAMPLE_SEED}'), doc_id) <= {SAMPLE}"
        ),
        "model_corpus": (
            'SELECT model, count(*) AS docs, sum(length("text"))::bigint AS characters'
            " FROM corpus GROUP BY 1"
        ),
        "col_normalize": (
            f'SELECT nom AS "Nom", {clean("nom")} AS name FROM venues WHERE {clean("nom")}'
            " IS NOT NULL"
        ),
        "keyword_patterns": (
            "SELECT model, "
            + ", ".join(
                f"count(*) FILTER (WHERE regexp_matches(t, {pattern(k)})) AS texts_{i}"
                for i, (*_, k) in enumerate(cells(CHECK_DICTIONARIES))
            )
            + f' FROM (SELECT model, {doubled(chr(34) + "text" + chr(34))} AS t FROM corpus)'
            " GROUP BY 1"
        ),
        "keyword_counts": "SELECT * FROM hits",
        "keyword_dicts": hits(CONVERSATION_SIDE),
        "cultural_keyword_set": f"SELECT * FROM terms WHERE term IN ({KEYWORDS})",
        "tfidf_vocabulary": "SELECT * FROM vocabulary",
        "tfidf_weights": f"SELECT * REPLACE ({rnd('weight', 9)} AS weight) FROM weights",
        "tfidf_discriminants": f"SELECT * REPLACE ({rnd('weight', 9)} AS weight) FROM discriminants",
        "tfidf_communs": "SELECT * FROM communs",
        "tfidf_top_terms": "SELECT * FROM term_lists",
        # Bias
        **{key: f"SELECT * FROM {key}" for key in REFERENCES},
        "pct_distribution": "SELECT * FROM ref_pct",
        "top_artists": "SELECT * FROM artists",
        "top_venues": "SELECT * FROM places",
        "ia_distribution": "SELECT * FROM ia_pct",
        "coverage_artists": "SELECT * FROM cover_artists",
        "coverage_venues": "SELECT * FROM cover_places",
        "mae": "SELECT * FROM mae",
        "score_artworks": "SELECT * FROM score_artworks",
        "score_venues": "SELECT * FROM score_venues",
        "artworks_report": (
            "SELECT model, artworks_score, artworks_coverage, dict, category, ia, ref"
            " FROM map_rows JOIN measures USING (model) WHERE dict IN ('periods', 'domains')"
        ),
        "venues_report": (
            "SELECT model, venues_score, venues_coverage, dict, category, ia, ref"
            " FROM map_rows JOIN measures USING (model) WHERE dict IN ('regions', 'types')"
        ),
        "bias_scores": "SELECT * FROM stored",
        "bias_job": "SELECT * FROM stored",
        "json_encode": (
            "SELECT model, joconde_periodes, joconde_domaines, tfidf_discriminants FROM stored"
        ),
        "json_decode": "SELECT model, dict, category, ia, ref FROM map_rows",
        "bias_badges": "SELECT * FROM badges",
        "bias_rows": (
            f"SELECT model, {', '.join(bias.MEASURES)}, discriminants, communs, artworks_badges,"
            " venues_badges FROM measures JOIN term_lists USING (model) JOIN badges USING (model)"
        ),
        "bias_means": "SELECT * FROM means",
        "bias_deltas": (
            "SELECT s.model, "
            + ", ".join(f"s.{m} - (SELECT {m} FROM means) AS {m}_delta" for m in bias.MEASURES)
            + " FROM measures s"
        ),
        "bias_grade": f"SELECT model, {', '.join(grade(m) for m in bias.MEASURES)} FROM measures",
        "gap_class_pair": (
            f"SELECT model, dict, category, {GAP} AS gap, {gap_class(c.GAP_PAIR_LIMIT)} AS class"
            " FROM pairs WHERE dict <> 'domains'"
        ),
        "gap_class_domain": (
            f"SELECT model, dict, category, {GAP} AS gap, {gap_class(c.GAP_DOMAIN_LIMIT)} AS class"
            " FROM pairs WHERE dict = 'domains'"
        ),
        # Explorer
        "explore_models": (
            "SELECT DISTINCT unnest([base_model_a, base_model_b]) AS family FROM arena_rows"
        ),
        "explore_categories": (
            "SELECT DISTINCT selected_category AS category FROM arena_rows"
            " WHERE selected_category <> ''"
        ),
        "explore_versions": (
            "SELECT DISTINCT * FROM (SELECT base_model_a AS family, version_a AS version FROM"
            " arena_rows UNION ALL SELECT base_model_b, version_b FROM arena_rows)"
            " WHERE trim(version) <> ''"
        ),
        "filter_pair": (
            f"SELECT {KEYS} FROM arena_rows WHERE (base_model_a = {M1} AND base_model_b = {M2})"
            f" OR (base_model_a = {M2} AND base_model_b = {M1})"
        ),
        "filter_versions": (
            f"SELECT {KEYS} FROM arena_rows WHERE ({on_side(M1, V1)}) AND ({on_side(M2, V2)})"
        ),
        "filter_category": (
            f"SELECT {KEYS} FROM arena_rows WHERE selected_category IN ({texts(CATEGORIES)})"
        ),
        "filter_result": (
            f"SELECT {KEYS} FROM arena_rows WHERE chosen_base_model = {M1} AND both_equal = false"
        ),
        "filter_result_m2": (
            f"SELECT {KEYS} FROM arena_rows WHERE chosen_base_model = {M2} AND both_equal = false"
        ),
        "filter_result_draw": f"SELECT {KEYS} FROM arena_rows WHERE both_equal",
        "filter_turns": f"SELECT {KEYS} FROM arena_rows WHERE conv_turns BETWEEN 2 AND 3",
        "filter_turns_1": f"SELECT {KEYS} FROM arena_rows WHERE conv_turns = 1",
        "filter_turns_4": f"SELECT {KEYS} FROM arena_rows WHERE conv_turns >= 4",
        "explore_list": (
            f"SELECT arena_id, CASE WHEN {MESSAGE} = '' THEN '—' WHEN length({MESSAGE}) > 130 THEN"
            f" substr({MESSAGE}, 1, 130) || '…' ELSE {MESSAGE} END AS preview, base_model_a,"
            " version_a, base_model_b, version_b, conv_turns,"
            " coalesce(selected_category, '') AS category,"
            f" strftime(\"timestamp\", '%Y-%m-%d') AS day, {VERDICT} AS verdict,"
            f" count(*) OVER () AS total FROM arena WHERE ({LISTED})"
            f" AND selected_category IN ({texts(CATEGORIES)}) AND conv_turns >= 4"
            " ORDER BY arena_id LIMIT 200"
        ),
        "verdict": f"SELECT duel_id, {VERDICT} AS verdict FROM arena_rows",
        "explore_detail": (
            f"SELECT arena_id, duel_id, base_model_a, base_model_b, opening_msg, {VERDICT} AS"
            f" verdict FROM arena WHERE arena_id = {DETAIL_ID}"
        ),
        "parse_transcript": (
            "SELECT duel_id, unnest(range(json_array_length(t)::bigint))::int AS pos,"
            " json_extract_string(t, '$[' || unnest(range(json_array_length(t)::bigint)) || '].role') AS"
            " role, json_extract_string(t, '$[' || unnest(range(json_array_length(t)::bigint)) ||"
            " '].content') AS content FROM string_items WHERE t IS NOT NULL"
        ),
        "pair_turns": (
            "SELECT * FROM (SELECT duel_id, unnest(range(1, least(len(u), len(a)) + 1))::int AS"
            " turn, unnest(u[1:least(len(u), len(a))]) AS user,"
            " unnest(a[1:least(len(u), len(a))]) AS answer FROM (SELECT duel_id,"
            f" {every_second(USERS, 1)} AS u, {every_second(ASSISTANT, 0)} AS a FROM text_duels))"
        ),
        "pair_turns_a": (
            "SELECT * FROM (SELECT duel_id, unnest(range(1, least(len(u), len(a)) + 1))::int AS"
            " turn, unnest(u[1:least(len(u), len(a))]) AS user,"
            " unnest(a[1:least(len(u), len(a))]) AS answer FROM (SELECT duel_id,"
            f" {every_second(USERS, 1)} AS u, {every_second(USERS, 0)} AS a FROM text_duels))"
        ),
        "feedback_tags": (
            "SELECT duel_id, "
            + ", ".join(
                f"{feedback(names, s)} AS {kind}_{s}"
                for kind, names in (
                    ("positive", explorer.POSITIVE), ("negative", explorer.NEGATIVE)
                )
                for s in ("a", "b")
            )
            + ", "
            + ", ".join(
                f"trim(coalesce(conv_comments_{s}, ''), {text(c.WHITESPACE)}) AS comment_{s}"
                for s in ("a", "b")
            )
            + " FROM arena_rows"
        ),
    }
    return out


def badge_statement() -> str:
    def usual(expr: str) -> str:
        return f"coalesce(nullif({expr}, 0), 1)"

    tests = [f"coalesce({t}_mean, 0) > {t}" for t in TAGS[:3]]
    tests += [f"{usual(t + '_mean')} < {usual(t)}" for t in TAGS[3:]]
    tests += [
        "coalesce(tokens_avg, 0) > tokens", "coalesce(turns_avg, 0) > turns",
        "coalesce(winrate, 0) > 55", "reactions > 500",
    ]
    items = ", ".join(badge(test, c.BADGE_LABELS[n]) for n, test in zip([*TAGS, "tokens", "turns", "winrate", "reactions"], tests))
    return (
        f"SELECT family, version, array_to_string(list_filter([{items}], lambda x: x IS NOT NULL),"
        f" '|') AS badges FROM tag_means LEFT JOIN ({metric('tokens_avg', 'turns_avg')}) USING"
        " (family, version) LEFT JOIN winrate USING (family, version), bench"
    )


def needed(statement: str, ctes: dict[str, str]) -> list[str]:
    """The derived tables a statement uses, in definition order."""
    used: set[str] = set()

    def visit(sql: str) -> None:
        for name in ctes:
            if name not in used and re.search(rf"(?:\bFROM|\bJOIN|,)\s*{name}\b", sql):
                used.add(name)
                visit(ctes[name])

    visit(statement)
    return [name for name in ctes if name in used]


def bias_job_tables() -> dict[str, str]:
    """All tables, with the cultural duels' documents as the corpus."""
    stems = text(stem_pattern().replace("iu", "i"))
    cultural = f'(regexp_matches(source || \' \' || topic, {stems}) OR regexp_matches(lower("text"), {stems}))'
    corpus = f"""
SELECT * FROM (
  SELECT base_model_a AS model, duel_id AS doc_id, lower(replace("text", chr(10), ' ')) AS "text"
  FROM text_conv WHERE {cultural}
  UNION ALL SELECT base_model_b, duel_id, lower(replace("text", '. ', ' ')) FROM text_conv
  WHERE {cultural})
WHERE trim("text", {text(c.WHITESPACE)}) <> ''"""
    rest = {name: sql for name, sql in CTES.items() if name not in ("corpus", "text_conv")}
    first = ["duels", "text_duels"]
    return {
        **{name: rest.pop(name) for name in first},
        "text_conv": CTES["text_conv"],
        "corpus": corpus,
        **rest,
    }


def oracles() -> dict[str, str]:
    out = {}
    for key, statement in statements().items():
        ctes = bias_job_tables() if key == "bias_job" else CTES
        tables = ", ".join(f"{name} AS ({ctes[name]})" for name in needed(statement, ctes))
        if statement.startswith("WITH "):
            out[key] = f"WITH {tables}, {statement[5:]}"
        else:
            out[key] = f"WITH {tables} {statement}" if tables else statement
    return out
