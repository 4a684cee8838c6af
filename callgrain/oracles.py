"""The registered queries as SQL over the given tables, written from the definitions."""

from __future__ import annotations

from callgrain.functions.text import QUERY_REWRITES, SCHEME_VARIANTS, STOP_WORDS
from callgrain.operators.scoring import digit_ranges

VIEWS = {
    "calls_dim": """SELECT o_orderkey AS row_id, r_name AS "StateName", n_name AS "DistrictName",
        c_mktsegment AS "Crop", o_orderpriority AS "QueryType", CAST(year(o_orderdate) AS BIGINT) AS "Year",
        CAST(month(o_orderdate) AS VARCHAR) AS "Month"
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey""",
    "calls_text": """SELECT u.conv_id, u.turn, u.text AS "QueryText", a.text AS "KccAns"
        FROM (SELECT * FROM conversations WHERE role = 'user') u
        LEFT JOIN (SELECT * FROM conversations WHERE role = 'assistant') a
        ON a.conv_id = u.conv_id AND a.turn = u.turn + 1""",
    "docs_text": """SELECT doc_id, lang AS "StateName", source AS "DistrictName", text AS "QueryText"
        FROM documents""",
    "places": "SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey",
    "edited": """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN left(p_name, length(p_name) - 1)
        WHEN 1 THEN replace(p_name, ' ', '') ELSE left(p_name, 1) || p_name END AS target FROM part""",
}


def _sql(body: str, *views: str, **named: str) -> str:
    parts = [f"{v} AS ({VIEWS[v]})" for v in views] + [f"{k} AS ({v})" for k, v in named.items()]
    return f"WITH {', '.join(parts)} {body}"


def _words_apart(x: str) -> str:
    """Every word with a blank of its own on both sides."""
    return rf"(' ' || regexp_replace(trim(regexp_replace({x}, '\s+', ' ', 'g')), ' ', '  ', 'g') || ' ')"


def norm_query_sql(t: str) -> str:
    x = rf"regexp_replace(lower({t}), '[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Nl}}\p{{Pc}}\x{{200C}}\x{{200D}}\s]', ' ', 'g')"
    steps = [QUERY_REWRITES[0], ("|(" + "|".join(STOP_WORDS) + ")|", ""), *QUERY_REWRITES[1:]]
    for phrase, repl in steps:
        words = phrase[1:-1] if phrase.startswith("|") else phrase
        pattern = words.replace(" ", " +")
        if phrase.startswith("|"):
            pattern = f" {pattern} "
        x = f"regexp_replace({_words_apart(x)}, '{pattern}', '{repl.replace('|', ' ')}', 'g')"
    y = _words_apart(x)
    return (
        f"(SELECT trim(regexp_replace(regexp_replace({_words_apart('z')}, ' scheme ', ' ', 'g'), ' +', ' ', 'g')) FROM "
        f"(SELECT CASE WHEN contains(y, ' status ') THEN 'status ' || regexp_replace(y, ' status ', '  ', 'g') "
        f"ELSE y END AS z FROM (SELECT {y} AS y)))"
    )


def norm_text_sql(t: str) -> str:
    word = r"\p{L}\p{N}_"
    x = rf"regexp_replace(lower(coalesce({t}, '')), '[^{word}\x{{0900}}-\x{{097F}}]+', ' ', 'g')"
    for variant in SCHEME_VARIANTS:
        body = variant.strip("|").replace(" ", r"\s*")
        if variant.startswith("|"):
            x = rf"regexp_replace({x}, '(^|[^{word}]){body}($|[^{word}])', '\1pmkisan\2', 'g')"
        else:
            x = f"regexp_replace({x}, '{body}', 'pmkisan', 'g')"
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def _lcs_sql(a: str, b: str) -> str:
    return f"""list_reduce(list_prepend(list_transform(range(0, length({b}) + 1), lambda x: 0::bigint),
        list_transform(string_split({a}, ''), lambda ch: [ascii(ch)::bigint])),
        lambda p, c: list_reduce(list_prepend([0::bigint], list_transform(range(1, length({b}) + 1), lambda j: [j])),
        lambda cur, jj: list_append(cur, CASE WHEN ascii(substr({b}, jj[1], 1)) = c[1] THEN p[jj[1]] + 1
        ELSE greatest(p[jj[1] + 1], cur[-1]) END)))[-1]"""


def _digits(c: str) -> str:
    return f"length(regexp_replace({c}, '[^{digit_ranges()}]', '', 'g'))"


def _scores(rows: str, id_col: str, text: str, stats: str, n_docs: str, formula: str, name: str) -> str:
    """Score of each row; ``formula`` may use len, ntok, digits, rare and x, the text."""
    return f"""SELECT {id_col}, round({formula}, 6) AS {name} FROM (
        SELECT r.{id_col}, r.{text} AS x, r.raw, length(r.{text}) AS len, {_digits(f'r.{text}')} AS digits,
        len(list_filter(string_split(r.{text}, ' '), lambda w: w <> '')) AS ntok, coalesce(k.rare, 0) AS rare
        FROM {rows} r LEFT JOIN (
            SELECT {id_col}, count(*) AS rare FROM (
                SELECT {id_col}, unnest(string_split({text}, ' ')) AS token FROM {rows}) w
            JOIN {stats} USING (token)
            WHERE token <> '' AND n <= greatest(2, CAST(floor(0.0005 * {n_docs}) AS BIGINT)) GROUP BY {id_col}
        ) k ON k.{id_col} = r.{id_col})"""


SPEC = """CASE WHEN ntok = 0 THEN 0.0 ELSE (least(len, 400) / 400.0::DOUBLE + digits / 10.0::DOUBLE
    + rare / greatest(ntok, 1)::DOUBLE) * CASE WHEN ntok < 4 THEN 0.4::DOUBLE ELSE 1 END END"""


def _answer_formula(marks: str) -> str:
    sentences = f"length(regexp_replace({marks}, '[^.?!।]', '', 'g'))"
    separators = f"length(regexp_replace({marks}, '[^/:\\-]', '', 'g'))"
    return f"""CASE WHEN len = 0 THEN 0.0 ELSE (least(len, 800) / 800.0::DOUBLE + digits / 12.0::DOUBLE
        + {sentences} / 5.0::DOUBLE + {separators} / 8.0::DOUBLE + rare / greatest(ntok, 1)::DOUBLE)
        * CASE WHEN least(len, 800) < 80 THEN 0.5::DOUBLE ELSE 1 END END"""


def _token_counts(rows: str, text: str) -> str:
    return f"""SELECT token, count(*) AS n FROM (SELECT unnest(string_split({text}, ' ')) AS token FROM {rows})
        WHERE token <> '' GROUP BY token"""


LINE = """SELECT row_id, "Month", CASE WHEN row_id % 50 = 0 THEN concat_ws(',', row_id, "StateName", "DistrictName", "Crop", "QueryType")
    WHEN row_id % 70 = 0 THEN concat_ws(',', row_id, "StateName", "DistrictName", "Crop", "QueryType", "Year", "Month", 'extra') END AS record
    FROM calls_dim"""

CALLS_AS_TEXT = """SELECT CAST(row_id AS VARCHAR) AS row_id, "StateName", "DistrictName", "Crop", "QueryType",
    CAST("Year" AS VARCHAR) AS "Year", "Month" FROM calls_dim"""

GROUPED = f"""SELECT q AS "QueryText", count(*) AS "count" FROM
    (SELECT {norm_query_sql('"QueryText"')} AS q FROM docs_text WHERE "QueryText" IS NOT NULL) WHERE q <> '' GROUP BY q"""


def _count(cols: list[str], limit: str = "") -> str:
    names = ", ".join(f'"{c}"' for c in cols)
    return _sql(f'SELECT {names}, count(*) AS "count" FROM calls_dim GROUP BY {names} ORDER BY "count" DESC, {names} {limit}', "calls_dim")


TARGETS = """SELECT r_name AS "StateName", n_name AS "DistrictName" FROM places
    UNION ALL SELECT 'ASIA', 'NOWHERE'"""


def _leaders(keys: str, col: str) -> str:
    """Values of a column by frequency within each target place."""
    on = " AND ".join(f't.{k} = c.{k}' for k in keys.split(", "))
    cols = ", ".join(f"c.{k}" for k in keys.split(", "))
    return f"""SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY n DESC, v) AS rk FROM (
        SELECT {cols}, c."{col}" AS v, count(*) AS n FROM calls_dim c JOIN (SELECT DISTINCT {keys} FROM targets) t ON {on}
        GROUP BY {cols}, c."{col}")"""


PAIR = '"StateName", "DistrictName"'
FALLBACK = """CASE WHEN max(CASE WHEN rk = 1 THEN v END) IN ('BUILDING', 'FURNITURE') AND max(CASE WHEN rk = 2 THEN v END) IS NOT NULL
    THEN max(CASE WHEN rk = 2 THEN v END) ELSE max(CASE WHEN rk = 1 THEN v END) END"""

DISTRICT_COUNTS = """SELECT p.r_name AS "StateName", ' ' || lower(p.n_name) AS "DistrictName", p.n_nationkey,
    count(c.row_id) AS "count" FROM places p LEFT JOIN calls_dim c
    ON c."StateName" = p.r_name AND c."DistrictName" = p.n_name GROUP BY 1, 2, 3
    UNION ALL SELECT 'ASIA', ' nowhere', -1, 0"""


def _match(targets: str, choices: str, fixed: bool) -> str:
    """Best choice of every target by brute force over all pairs."""
    fix = "CASE WHEN target LIKE 'hh%' THEN 'old bolt' END" if fixed else "CAST(NULL AS VARCHAR)"
    # compared without case and signs, as the definition says; the tables have no signs
    a, b = "lower(target)", "lower(choice)"
    return f"""SELECT t.target, coalesce(t.official, b.choice) AS match, CAST(CASE WHEN t.official IS NULL THEN b.score END AS DOUBLE) AS score,
        CASE WHEN t.official IS NOT NULL THEN 'override' WHEN b.choice IS NOT NULL THEN 'fuzzy' END AS via
        FROM (SELECT DISTINCT target, {fix} AS official FROM {targets}) t LEFT JOIN (
            SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, choice) AS rk FROM (
                SELECT target, choice, CAST(round(200.0 * {_lcs_sql(a, b)} / (length(target) + length(choice))) AS INTEGER) AS score
                FROM (SELECT DISTINCT target FROM {targets}), (SELECT DISTINCT choice FROM {choices})))
            WHERE rk = 1 AND score >= 93
        ) b USING (target)"""


PART_NAMES = "SELECT DISTINCT p_name AS choice FROM part"
PART_NAMES_TYPES = PART_NAMES + " UNION SELECT DISTINCT p_type FROM part"
BALANCE = """SELECT ' Nation-' || s_nationkey AS "District", round(sum(s_acctbal), 2) AS value, s_nationkey FROM supplier GROUP BY s_nationkey"""


def _dbscan(vectors: str, min_cos: float, min_pts: int, p: str = "") -> dict[str, str]:
    """Clusters of the rows (vec_id, part, e): core rows, their components, numbers per part."""
    return {
        f"{p}v": vectors,
        f"{p}near": f"SELECT a.vec_id AS a, b.vec_id AS b FROM {p}v a JOIN {p}v b ON a.part = b.part "
        f"AND list_cosine_similarity(a.e, b.e) >= {min_cos}",
        f"{p}core": f"SELECT a FROM {p}near GROUP BY a HAVING count(*) >= {min_pts}",
        f"{p}g": f"SELECT a, b FROM {p}near WHERE a IN (SELECT a FROM {p}core) AND b IN (SELECT a FROM {p}core)",
        f"{p}l(a, r)": f"SELECT a, a FROM {p}core UNION SELECT g.b, l.r FROM {p}l l JOIN {p}g g ON l.a = g.a WHERE g.b > l.r",
        f"{p}roots": f"SELECT a, min(r) AS r FROM {p}l GROUP BY a",
        f"{p}kept": f"SELECT r, count(*) AS n FROM {p}roots GROUP BY r HAVING count(*) >= {min_pts}",
        f"{p}ids": f"SELECT r, row_number() OVER (PARTITION BY part ORDER BY r) - 1 AS label FROM {p}kept JOIN {p}v ON vec_id = r",
        f"{p}labels": f"SELECT a AS vec_id, CAST(label AS INTEGER) AS label FROM {p}roots JOIN {p}ids USING (r)",
    }


def _embeddings_by(part: str) -> str:
    return f"SELECT vec_id, {part} AS part, embedding::DOUBLE[] AS e FROM embeddings"


def _recursive(body: str, named: dict[str, str]) -> str:
    parts = ", ".join(f"{k} AS ({v})" for k, v in named.items())
    return f"WITH RECURSIVE {parts} {body}"


CENTROIDS = """SELECT label, list(value ORDER BY pos) AS c FROM (
    SELECT label, pos, avg(e::DOUBLE) AS value FROM (
        SELECT label, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS pos FROM embeddings{where}) GROUP BY label, pos)
    GROUP BY label"""

CLEAN_DOCS = f'SELECT doc_id, NULL AS raw, {norm_text_sql("text")} AS q_clean FROM documents'
ANSWERS = f"""SELECT conv_id * 4294967296 + turn AS answer_id, conv_id, turn, "QueryText", "KccAns", "KccAns" AS raw,
    {norm_text_sql('"QueryText"')} AS q_clean, {norm_text_sql('"KccAns"')} AS a_clean FROM calls_text"""
GIVEN = """SELECT *, CAST(conv_id % 9 - 1 AS INTEGER) AS question_cluster_id, CAST(turn // 2 - 1 AS INTEGER) AS answer_cluster_id
    FROM rows_ WHERE q_clean <> ''"""


def _given(body: str) -> str:
    asked = "(SELECT * FROM rows_ WHERE q_clean <> '')"
    return _sql(
        body, "calls_text", rows_=ANSWERS, given=GIVEN, stats=_token_counts(asked, "a_clean"),
        scored=_scores(
            "(SELECT * FROM given WHERE a_clean <> '' AND question_cluster_id >= 0)", "answer_id", "a_clean", "stats",
            f"(SELECT count(*) FROM {asked} z)", _answer_formula("x"), "s",
        ).replace(", 6) AS s", ", 12) AS s"),
        a="SELECT given.*, scored.s FROM given JOIN scored USING (answer_id)",
    )


def _best(groups: str, where: str = "") -> str:
    return f"""SELECT {groups}, "KccAns" FROM (SELECT *, row_number() OVER (PARTITION BY {groups} ORDER BY s DESC, answer_id) AS rk
        FROM a{where}) WHERE rk = 1"""


# --- intents by the letter model --------------------------------------------------------------


def _letters(text: str) -> str:
    return f"list_transform(range(97, 123), lambda k: (length({text}) - length(replace({text}, chr(k::INTEGER), '')))::DOUBLE)"


def _unit_vectors(id_col: str, part: str, text: str, rows: str) -> str:
    return f"""SELECT vec_id, part, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS e FROM (
        SELECT {id_col} AS vec_id, {part} AS part, {_letters(text)} AS c FROM {rows}) WHERE list_sum(c) > 0"""


def _unit_or_zero(id_col: str, part: str, text: str, rows: str) -> str:
    return f"""SELECT vec_id, part, list_transform(c, lambda x: x / greatest(sqrt(list_dot_product(c, c)), 1)) AS e FROM (
        SELECT {id_col} AS vec_id, {part} AS part, {_letters(text)} AS c FROM {rows})"""


def _values(id_col: str, rows: str) -> str:
    """One row per place of the letter vectors of normalised questions."""
    return f"""SELECT {id_col}, CAST(pos - 1 AS INTEGER) AS pos, round(CAST(CAST(x AS FLOAT) AS DOUBLE), 5) AS value FROM (
        SELECT vec_id AS {id_col}, unnest(e) AS x, generate_subscripts(e, 1) AS pos
        FROM ({_unit_or_zero(id_col, "0", "q_clean", rows)}))"""


INTENTS = {
    "calls_text": VIEWS["calls_text"],
    "rows_": ANSWERS,
    "asked": "SELECT * FROM rows_ WHERE q_clean <> ''",
    "questions": """SELECT row_number() OVER (ORDER BY q_clean) - 1 AS question_id, "QueryText", q_clean, NULL AS raw FROM (
        SELECT *, row_number() OVER (PARTITION BY q_clean ORDER BY conv_id, turn) AS rk FROM asked) WHERE rk = 1""",
    **_dbscan(_unit_vectors("question_id", "0", "q_clean", "questions"), 0.97, 4),
    "clustered": """SELECT q.*, coalesce(label, -1) AS question_cluster_id FROM questions q LEFT JOIN labels ON vec_id = question_id""",
}
INTENT_ANSWERS = {
    **INTENTS,
    "answers": """SELECT row_number() OVER (ORDER BY question_cluster_id, a_clean) - 1 AS answer_id, * FROM (
        SELECT question_cluster_id, a_clean, "KccAns", NULL AS raw,
        row_number() OVER (PARTITION BY question_cluster_id, a_clean ORDER BY conv_id, turn) AS rk
        FROM asked JOIN (SELECT q_clean, question_cluster_id FROM clustered) USING (q_clean)
        WHERE a_clean <> '' AND question_cluster_id >= 0) WHERE rk = 1""",
    **_dbscan(_unit_vectors("answer_id", "question_cluster_id", "a_clean", "answers"), 0.98, 3, "a_"),
    "a_stats": _token_counts("asked", "a_clean"),
    "a_scored": _scores("answers", "answer_id", "a_clean", "a_stats", "(SELECT count(*) FROM asked)", _answer_formula("x"), "s")
    .replace(", 6) AS s", ", 12) AS s"),
    "a": """SELECT answer_id, question_cluster_id, coalesce(label, -1) AS answer_cluster_id, "KccAns", a_clean, s
        FROM answers JOIN a_scored USING (answer_id) LEFT JOIN a_labels ON vec_id = answer_id""",
}
INTENT_SUMMARIES = {
    **INTENT_ANSWERS,
    "q_stats": _token_counts("questions", "q_clean"),
    "q_scored": _scores("questions", "question_id", "q_clean", "q_stats", "(SELECT count(*) FROM questions)", SPEC, "spec")
    .replace(", 6) AS spec", ", 12) AS spec"),
    "centroid": """SELECT question_cluster_id, list(m ORDER BY pos) AS c FROM (
        SELECT question_cluster_id, pos, avg(x) AS m FROM (
            SELECT question_cluster_id, unnest(e) AS x, generate_subscripts(e, 1) AS pos
            FROM clustered JOIN v ON vec_id = question_id WHERE question_cluster_id >= 0) GROUP BY 1, 2) GROUP BY 1""",
    "ranked": """SELECT question_cluster_id, "QueryText", row_number() OVER (PARTITION BY question_cluster_id ORDER BY rep DESC, question_id) AS by_rep,
        row_number() OVER (PARTITION BY question_cluster_id ORDER BY rep + spec DESC, question_id) AS by_desc FROM (
        SELECT question_id, question_cluster_id, "QueryText", list_cosine_similarity(e, c) AS rep, spec
        FROM clustered JOIN v ON vec_id = question_id JOIN centroid USING (question_cluster_id) JOIN q_scored USING (question_id))""",
    "modes": f"""SELECT question_cluster_id, '[' || string_agg('{{"answer_cluster_id":' || answer_cluster_id || ',"KccAns":'
        || CAST(to_json("KccAns") AS VARCHAR) || '}}', ',' ORDER BY answer_cluster_id) || ']' AS j
        FROM ({_best("question_cluster_id, answer_cluster_id", " WHERE answer_cluster_id >= 0")}) GROUP BY 1""",
}

# Prim's algorithm: the node with the cheapest link to the tree joins it, all others look again
TREE_WEIGHTS = {
    "u": """SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e
        FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) WHERE list_dot_product(e, e) > 0""",
    "d": "SELECT a.vec_id AS a, b.vec_id AS b, list_distance(a.e, b.e) AS d FROM u a JOIN u b ON a.vec_id <> b.vec_id",
    "core": """SELECT a, max(d) AS c FROM (SELECT a, d, row_number() OVER (PARTITION BY a ORDER BY d) AS k FROM d) WHERE k <= 5 GROUP BY a""",
    "m": "SELECT d.a, d.b, greatest(d, x.c, y.c) AS w FROM d JOIN core x ON x.a = d.a JOIN core y ON y.a = d.b",
    "p(step, node, best, inside)": """SELECT 0, vec_id, CASE WHEN vec_id = (SELECT min(vec_id) FROM u) THEN 0.0::DOUBLE
        ELSE 'infinity'::DOUBLE END, false FROM u
        UNION ALL
        SELECT step + 1, p.node, CASE WHEN p.inside OR p.node = t.node THEN p.best ELSE least(p.best, m.w) END, p.inside OR p.node = t.node
        FROM p CROSS JOIN (SELECT arg_min(node, (best, node)) AS node FROM p WHERE NOT inside) t
        LEFT JOIN m ON m.a = t.node AND m.b = p.node WHERE step < (SELECT count(*) FROM u)""",
}

ORACLES: dict[str, str] = {
    "complete_lines": _sql(f"""SELECT * FROM ({CALLS_AS_TEXT}) WHERE CAST(row_id AS BIGINT) NOT IN (SELECT max(row_id) FROM calls_dim GROUP BY "Year")""", "calls_dim"),
    "stored_calls": _sql("""SELECT * REPLACE (CAST("Month" AS BIGINT) AS "Month") FROM calls_dim WHERE "Year" <> 1997 OR "StateName" <> 'ASIA'""", "calls_dim"),
    "stored_filter": _sql("""SELECT * REPLACE (CAST("Month" AS BIGINT) AS "Month") FROM calls_dim WHERE CAST("Month" AS BIGINT) = 3
        AND "StateName" IN ('ASIA', 'EUROPE') AND ("Year" = 1995 OR ("Year" = 1997 AND "StateName" <> 'ASIA'))""", "calls_dim"),
    "stored_group_samples": _sql(
        f"""SELECT left(trim("QueryText", e' \\n\\t\\r'), 400) AS "QueryText", "DistrictName" AS "KccAns" FROM docs_text
        WHERE {norm_query_sql('"QueryText"')} = (SELECT "QueryText" FROM grouped ORDER BY "count" DESC, "QueryText" LIMIT 1)
        ORDER BY doc_id LIMIT 25""", "docs_text", grouped=GROUPED),
    "page_stream": "SELECT *, event_id // 1000 * 1000 AS page_offset FROM events",
    "stream_distinct": "SELECT * FROM events",
    "name_match_grouped": f"""WITH t AS (SELECT DISTINCT p_brand AS brand, p_name AS target FROM part WHERE p_partkey % 2 = 1),
        c AS (SELECT DISTINCT p_brand AS brand, p_name AS choice FROM part WHERE p_partkey % 2 = 0),
        s AS (SELECT t.brand, target, choice, CAST(round(200.0 * {_lcs_sql("lower(target)", "lower(choice)")} / (length(target) + length(choice))) AS INTEGER) AS score
            FROM t JOIN c ON t.brand = c.brand),
        b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY brand, target ORDER BY score DESC, choice) AS rk FROM s) WHERE rk = 1 AND score >= 80)
        SELECT brand, target, choice AS match, CAST(score AS DOUBLE) AS score, CASE WHEN choice IS NOT NULL THEN 'fuzzy' END AS via
        FROM t LEFT JOIN b USING (brand, target)""",
    "density_cluster_tree": _recursive(
        "SELECT vec_id, coalesce(label, -1) AS cluster_id FROM v LEFT JOIN labels USING (vec_id)",
        _dbscan(_embeddings_by("0"), 0.30, 8)),
    "hierarchy_weights": _recursive(
        """SELECT row_number() OVER (ORDER BY best) - 1 AS nth, round(best, 6) AS w FROM p
        WHERE step = (SELECT count(*) FROM u) AND node <> (SELECT min(vec_id) FROM u)""", TREE_WEIGHTS).replace("d AS (", "d AS MATERIALIZED (")
        .replace("core AS (", "core AS MATERIALIZED (").replace("m AS (", "m AS MATERIALIZED ("),
    "intent_settings": _recursive(
        """SELECT 'conversations' AS input, CAST(NULL AS BIGINT) AS "limit", 'letters' AS embedder, 256 AS chunk, 0.97::DOUBLE AS min_cos,
        4 AS min_cluster_size, 0.98::DOUBLE AS answer_min_cos, 3 AS answer_min_cluster_size, 256 AS dim,
        (SELECT count(*) FROM questions) AS questions, (SELECT count(*) FROM a) AS answers,
        (SELECT count(DISTINCT question_cluster_id) FROM a) AS summaries, (SELECT count(*) FROM questions) AS embeddings,
        (SELECT max(question_cluster_id) + 1 FROM clustered) AS question_clusters""", INTENT_ANSWERS),
    "scan_parquet": "SELECT * FROM orders",
    "scan_csv": _sql(CALLS_AS_TEXT + " WHERE row_id % 50 <> 0 AND row_id % 70 <> 0", "calls_dim"),
    "csv_header_names": _sql('SELECT CAST(row_id AS VARCHAR) AS row_id, "StateName" AS "State_Name", "Crop" FROM calls_dim', "calls_dim"),
    "scan_project_limit": "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 500",
    "quarantine_rows": _sql("SELECT record FROM lines WHERE record IS NOT NULL", "calls_dim", lines=LINE),
    "quarantine_good_rows": _sql('SELECT CAST(row_id AS VARCHAR) AS row_id, "Month" FROM lines WHERE record IS NULL', "calls_dim", lines=LINE),
    "pages_union": "SELECT *, event_id // 1000 * 1000 AS page_offset FROM events",
    "valid_pages": "SELECT *, event_id // 1000 * 1000 AS page_offset FROM events WHERE event_id // 1000 % 5 <> 4",
    "missing_pages": """SELECT "offset" FROM (SELECT unnest(range(0, (SELECT count(*) FROM events), 100)) AS "offset")
        WHERE "offset" NOT IN (SELECT event_id // 100 * 100 FROM events WHERE event_id // 100 % 7 <> 3)""",
    "missing_after_errors": """SELECT "offset" FROM (SELECT unnest(range(0, (SELECT count(*) FROM events), 1000)) AS "offset")
        WHERE "offset" // 1000 % 5 = 4""",
    "page_progress": """SELECT count(m.o) AS done, count(*) AS total, count(*) - count(m.o) AS missing
        FROM (SELECT unnest(range(0, (SELECT count(*) FROM events), 100)) AS o) e
        LEFT JOIN (SELECT DISTINCT event_id // 100 * 100 AS o FROM events WHERE event_id // 100 % 7 <> 3) m ON e.o = m.o""",
    "ingest_stream": "SELECT * FROM events",
    "quarantined_pages": """SELECT DISTINCT '{"error":"limit, reached"}' AS record, event_id // 1000 * 1000 AS page_offset, true AS bad_page
        FROM events WHERE event_id // 1000 % 5 = 4""",
    "stream_counts": 'SELECT event_type, count(*) AS "count" FROM events GROUP BY event_type',
    "api_slice": _sql("""SELECT * FROM calls_dim WHERE "Year" = 1997 AND "StateName" = 'ASIA' ORDER BY row_id LIMIT 500 OFFSET 100""", "calls_dim"),
    "dedup_rows": "SELECT DISTINCT text, lang, source, n_chars FROM documents",
    "merge_years": _sql("""SELECT * FROM calls_dim WHERE "StateName" = 'ASIA'""", "calls_dim"),
    "sample_n": "SELECT doc_id, lang FROM documents ORDER BY md5('7|' || doc_id), doc_id LIMIT 300",
    "keyword_catalog": """SELECT count(*) AS with_keyword, count(*) FILTER (contains(lower(p_name), 'red') OR contains(lower(p_name), 'blue'))
        AS with_keyword_and_other FROM part WHERE contains(lower(p_name), 'widget')""",
    "sink_csv": _sql(CALLS_AS_TEXT, "calls_dim"),
    "facet_filter": _sql("""SELECT * FROM calls_dim WHERE "StateName" IN ('ASIA', 'EUROPE') AND "Crop" IN ('MACHINERY', 'FURNITURE')
        AND "QueryType" IN ('1-URGENT', '2-HIGH') AND TRY_CAST("Month" AS BIGINT) = 3""", "calls_dim"),
    "filter_month": _sql('SELECT * FROM calls_dim WHERE TRY_CAST("Month" AS BIGINT) = 7', "calls_dim"),
    "search_text": _sql("""SELECT * FROM calls_text WHERE regexp_matches(coalesce("QueryText", ''), 'ering|auou[a-d]', 'i')
        OR regexp_matches(coalesce("KccAns", ''), 'ering|auou[a-d]', 'i')""", "calls_text"),
    "search_text_literal": _sql("""SELECT * FROM calls_text WHERE contains(lower(coalesce("QueryText", '')), 'tion.')
        OR contains(lower(coalesce("KccAns", '')), 'tion.')""", "calls_text"),
    "facet_values": _sql('SELECT DISTINCT trim("DistrictName") AS "DistrictName" FROM calls_dim WHERE trim("DistrictName") <> \'\'', "calls_dim"),
    "facet_months": _sql('SELECT DISTINCT TRY_CAST("Month" AS BIGINT) AS m FROM calls_dim WHERE TRY_CAST("Month" AS BIGINT) IS NOT NULL', "calls_dim"),
    "default_query_type": _sql("""SELECT DISTINCT "QueryType" FROM calls_dim WHERE contains(lower("QueryType"), 'not')
        AND contains(lower("QueryType"), 'specified') ORDER BY 1 LIMIT 1""", "calls_dim"),
    "overview_counts": _sql("""SELECT count(*) AS total_rows, count(*) FILTER ("QueryType" = '1-URGENT') AS filtered_rows FROM calls_dim""", "calls_dim"),
    "count_by": _count(["StateName", "DistrictName", "Crop"]),
    "top_districts": _count(["DistrictName"], "LIMIT 10"),
    "top_states": _count(["StateName"], "LIMIT 10"),
    "top_query_types": _count(["QueryType"], "LIMIT 10"),
    "top_crops": _count(["Crop"], "LIMIT 10"),
    "norm_query": f"SELECT doc_id, {norm_query_sql('text')} AS norm FROM documents",
    "norm_text": f"SELECT doc_id, {norm_text_sql('text')} AS norm FROM documents",
    "top_query_texts": _sql('SELECT * FROM grouped ORDER BY "count" DESC, "QueryText" LIMIT 50', "docs_text", grouped=GROUPED),
    "descriptive_answers": _sql(
        f"""SELECT q AS "QueryText", count(*) AS "count", max(n) AS max_ans_len, round(avg(n), 6) AS avg_ans_len FROM (
        SELECT {norm_query_sql('"QueryText"')} AS q, CAST(strlen(trim(coalesce("KccAns", ''), e' \\n\\t\\r')) AS BIGINT) AS n
        FROM calls_text WHERE "QueryText" IS NOT NULL) WHERE q <> '' GROUP BY q ORDER BY max_ans_len DESC, q LIMIT 50""",
        "calls_text"),
    "longest_answers": _sql("""SELECT conv_id, turn, "QueryText", "KccAns", CAST(strlen(trim(coalesce("KccAns", ''), e' \\n\\t\\r')) AS BIGINT) AS ans_len
        FROM calls_text WHERE "QueryText" IS NOT NULL ORDER BY ans_len DESC, conv_id, turn LIMIT 20""", "calls_text"),
    "group_samples": _sql(
        f"""SELECT left(trim("QueryText", e' \\n\\t\\r'), 400) AS "QueryText", "DistrictName" AS "KccAns" FROM docs_text
        WHERE {norm_query_sql('"QueryText"')} = (SELECT "QueryText" FROM grouped ORDER BY "count" DESC, "QueryText" LIMIT 1)
        ORDER BY doc_id LIMIT 25""", "docs_text", grouped=GROUPED),
    "paged_top_queries": _sql('SELECT * FROM grouped ORDER BY "count" DESC, "QueryText" LIMIT 25 OFFSET 25', "docs_text", grouped=GROUPED),
    "page_count": _sql("SELECT count(*) AS n_rows, greatest(CAST(ceil(count(*) / 50.0) AS BIGINT), 1) AS n_pages FROM grouped", "docs_text", grouped=GROUPED),
    "place_profile": _sql(
        f"""SELECT t."StateName", t."DistrictName", coalesce(c.top, 'N/A') AS top_crop, coalesce(k.top, 'N/A') AS top_query_type
        FROM targets t
        LEFT JOIN (SELECT {PAIR}, {FALLBACK} AS top FROM ({_leaders(PAIR, 'Crop')}) GROUP BY {PAIR}) c USING ({PAIR})
        LEFT JOIN (SELECT {PAIR}, max(v) AS top FROM ({_leaders(PAIR, 'QueryType')}) WHERE rk = 1 GROUP BY {PAIR}) k USING ({PAIR})""",
        "calls_dim", "places", targets=TARGETS),
    "place_top_crop": _sql(
        f"""SELECT t."StateName", coalesce(c.top, 'N/A') AS "Crop" FROM (SELECT DISTINCT "StateName" FROM targets) t LEFT JOIN (
        SELECT "StateName", {FALLBACK} AS top FROM ({_leaders('"StateName"', 'Crop')}) GROUP BY "StateName") c USING ("StateName")""",
        "calls_dim", "places", targets=TARGETS),
    "place_top_qtype": _sql(
        f"""SELECT t."StateName", t."DistrictName", coalesce(k.v, 'N/A') AS "QueryType" FROM targets t
        LEFT JOIN (SELECT {PAIR}, v FROM ({_leaders(PAIR, 'QueryType')}) WHERE rk = 1) k USING ({PAIR})""",
        "calls_dim", "places", targets=TARGETS),
    "top_crop_is": _sql("""SELECT "DistrictName", calls, value_calls FROM (
        SELECT "DistrictName", (SELECT count(*) FROM calls_dim d WHERE d."DistrictName" = c."DistrictName") AS calls, n AS value_calls, "Crop",
        row_number() OVER (PARTITION BY "DistrictName" ORDER BY n DESC, "Crop") AS rk
        FROM (SELECT "DistrictName", "Crop", count(*) AS n FROM calls_dim WHERE "Crop" <> 'BUILDING' GROUP BY 1, 2) c)
        WHERE rk = 1 AND "Crop" = 'MACHINERY'""", "calls_dim"),
    "boundary_features": _sql("""SELECT r_name AS "StateName", s_name AS "DistrictName",
        '{"type":"Point","coordinates":[' || s_suppkey || ',' || n_nationkey || ']}' AS geometry
        FROM supplier JOIN places ON s_nationkey = n_nationkey""", "places"),
    "geo_district_counts": _sql(DISTRICT_COUNTS, "calls_dim", "places"),
    "geo_state_counts": _sql("""SELECT lower(r_name) AS "StateName", count(c.row_id) AS "count" FROM region
        LEFT JOIN calls_dim c ON c."StateName" = r_name GROUP BY 1 UNION ALL SELECT 'nowhere', 0""", "calls_dim"),
    "measure_table": _sql('SELECT "District", value FROM m', m=BALANCE),
    "geo_measure": _sql("""SELECT r_name AS "StateName", lower(n_name) AS "DistrictName", n_nationkey, value
        FROM places LEFT JOIN m ON s_nationkey = n_nationkey""", "places", m=BALANCE),
    "choropleth_bins": _sql("""SELECT d.*, CASE WHEN hi = lo THEN 9 ELSE least(CAST(floor(("count" - lo) * 9.0::DOUBLE / (hi - lo)) AS INTEGER) + 1, 9) END AS bin
        FROM d, (SELECT min("count") AS lo, max("count") AS hi FROM d)""", "calls_dim", "places", d=DISTRICT_COUNTS),
    "name_norm": """SELECT p_partkey, replace(replace(lower(trim(' ' || p_name || '-' || p_brand || ' ')), ' ', ''), '-', '') AS name,
        replace(replace(lower(p_name), ' ', ''), '-', '') AS repaired,
        CASE p_partkey % 3 WHEN 0 THEN 'east' || lower(p_type) WHEN 1 THEN 'north' || lower(p_type) ELSE 'city' END AS directed FROM part""",
    "suggest_names": "SELECT DISTINCT p_name FROM part WHERE contains(lower(p_name), 'wid') ORDER BY p_name LIMIT 10",
    "name_match": _sql(_match("edited", "choices", True), "edited", choices=PART_NAMES),
    "name_unmatched": _sql("SELECT target FROM m WHERE match IS NULL", "edited", choices=PART_NAMES, m=_match("edited", "choices", True)),
    "name_remaining": _sql("SELECT choice FROM choices WHERE choice NOT IN (SELECT match FROM m WHERE match IS NOT NULL)",
        "edited", choices=PART_NAMES_TYPES, m=_match("edited", "choices", False)),
    "overrides": _sql("SELECT DISTINCT target AS raw, 'old bolt' AS official FROM edited WHERE target LIKE 'hh%'", "edited"),
    "token_stats": _sql("SELECT * FROM s", docs=CLEAN_DOCS, s=_token_counts("docs", "q_clean")),
    "specificity": _sql(_scores("docs", "doc_id", "q_clean", "s", "(SELECT count(*) FROM docs)", SPEC, "spec_score"),
        docs=CLEAN_DOCS, s=_token_counts("docs", "q_clean")),
    "answer_score": _sql(_scores("rows_", "answer_id", "a_clean", "s", "(SELECT count(*) FROM rows_)", _answer_formula("x"), "desc_score"),
        "calls_text", rows_=ANSWERS, s=_token_counts("rows_", "a_clean")),
    "answer_score_raw": _sql(
        _scores("rows_", "answer_id", "a_clean", "s", "(SELECT count(*) FROM rows_)", _answer_formula("coalesce(raw, '')"), "desc_score"),
        "calls_text", rows_=ANSWERS, s=_token_counts("rows_", "a_clean")),
    "density_cluster": _recursive(
        "SELECT vec_id, coalesce(label, -1) AS cluster_id FROM v LEFT JOIN labels USING (vec_id)",
        _dbscan(_embeddings_by("0"), 0.30, 8)),
    "density_cluster_parts": _recursive(
        "SELECT vec_id, coalesce(labels.label, -1) AS cluster_id, part AS label FROM v LEFT JOIN labels USING (vec_id)",
        _dbscan(_embeddings_by("label"), 0.25, 3)),
    "cluster_centroid": """SELECT label, CAST(pos - 1 AS INTEGER) AS pos, round(avg(e::DOUBLE), 6) AS value FROM (
        SELECT label, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1, 2""",
    "intent_questions": f"""SELECT row_number() OVER (ORDER BY q_clean) - 1 AS question_id, text AS "QueryText", q_clean, lang,
        count(*) OVER (PARTITION BY lang) AS cluster_size FROM (
        SELECT text, q_clean, lang, row_number() OVER (PARTITION BY q_clean ORDER BY doc_id) AS rk FROM (
            SELECT doc_id, text, lang, {norm_text_sql('text')} AS q_clean FROM documents) WHERE q_clean <> '') WHERE rk = 1""",
    "intent_representative": _sql("""SELECT label, vec_id, round(s, 6) AS rep_score FROM (
        SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS rk FROM (
            SELECT label, vec_id, list_cosine_similarity(embedding::DOUBLE[], c) AS s FROM embeddings JOIN m USING (label))) WHERE rk = 1""",
        m=CENTROIDS.format(where="")),
    "intent_descriptive": _sql("""SELECT label, doc_id, round(d, 6) AS desc_score FROM (
        SELECT *, row_number() OVER (PARTITION BY label ORDER BY d DESC, doc_id) AS rk FROM (
            SELECT label, doc_id, CASE WHEN label >= 0 AND list_sum(e) > 0 THEN list_cosine_similarity(e, c) ELSE 0 END + spec AS d
            FROM vectors LEFT JOIN m USING (label) JOIN scored USING (doc_id))) WHERE rk = 1""",
        docs=CLEAN_DOCS, vectors=f"""SELECT vec_id AS doc_id, part AS label, e FROM ({_unit_or_zero("doc_id", "CAST(doc_id % 9 - 1 AS INTEGER)", "q_clean", "docs")})""",
        m="""SELECT label, list(value ORDER BY pos) AS c FROM (SELECT label, pos, avg(x) AS value FROM (
            SELECT label, unnest(e) AS x, generate_subscripts(e, 1) AS pos FROM vectors WHERE label >= 0) GROUP BY 1, 2) GROUP BY 1""",
        s=_token_counts("docs", "q_clean"),
        scored=_scores("docs", "doc_id", "q_clean", "s", "(SELECT count(*) FROM docs)", SPEC, "spec").replace(", 6) AS spec", ", 12) AS spec")),
    "embed_letters": _sql(_values("doc_id", "docs"), docs=CLEAN_DOCS),
    "intent_embeddings": _recursive(_values("question_id", "questions"), INTENTS),
    "intent_tables": _recursive(
        """SELECT question_id, q_clean, question_cluster_id, count(*) OVER (PARTITION BY question_cluster_id) AS cluster_size,
        round(spec, 6) AS spec_score, round(rep, 6) AS rep_score, round(rep + spec, 6) AS desc_score FROM (
            SELECT q.question_id, q.q_clean, q.question_cluster_id, spec, coalesce(list_cosine_similarity(v.e, centroid.c), 0) AS rep
            FROM clustered q JOIN q_scored USING (question_id) LEFT JOIN v ON v.vec_id = q.question_id
            LEFT JOIN centroid ON centroid.question_cluster_id = q.question_cluster_id)""", INTENT_SUMMARIES),
    "best_answer_overall": _given(_best("question_cluster_id")),
    "best_answer_per_cluster": _given(_best("question_cluster_id, answer_cluster_id", " WHERE answer_cluster_id >= 0")),
    "intent_summary_texts": _given(f"""SELECT b.question_cluster_id, r."QueryText" AS rep_question, d."QueryText" AS desc_question,
        b."KccAns" AS best_answer_overall FROM ({_best("question_cluster_id")}) b
        JOIN (SELECT *, row_number() OVER (PARTITION BY question_cluster_id ORDER BY length(q_clean) DESC, answer_id) AS rk FROM given) r
            ON r.question_cluster_id = b.question_cluster_id AND r.rk = 1
        JOIN (SELECT *, row_number() OVER (PARTITION BY question_cluster_id ORDER BY length(q_clean), answer_id) AS rk FROM given) d
            ON d.question_cluster_id = b.question_cluster_id AND d.rk = 1"""),
    "intent_answer_modes": _given(f"""SELECT question_cluster_id, answer_cluster_id, left(trim("KccAns", e' \\n\\t\\r'), 800) AS "KccAns"
        FROM ({_best("question_cluster_id, answer_cluster_id", " WHERE answer_cluster_id >= 0")})"""),
    "intent_clusters": _recursive("SELECT question_id, q_clean, question_cluster_id FROM clustered", INTENTS),
    "intent_assign": _recursive("SELECT conv_id, turn, question_cluster_id FROM asked JOIN clustered USING (q_clean)", INTENTS),
    "intent_answers": _recursive(
        """SELECT answer_id, question_cluster_id, answer_cluster_id, "KccAns", a_clean, round(s, 6) AS desc_score FROM a""", INTENT_ANSWERS),
    "intent_summaries": _recursive(
        f"""SELECT b.question_cluster_id, r."QueryText" AS rep_question, d."QueryText" AS desc_question,
        b."KccAns" AS best_answer_overall, coalesce(j, '[]') AS best_answer_per_answer_cluster
        FROM ({_best("question_cluster_id")}) b
        JOIN ranked r ON r.question_cluster_id = b.question_cluster_id AND r.by_rep = 1
        JOIN ranked d ON d.question_cluster_id = b.question_cluster_id AND d.by_desc = 1
        LEFT JOIN modes ON modes.question_cluster_id = b.question_cluster_id""", INTENT_SUMMARIES),
}
ORACLES["intent_summaries_stored"] = ORACLES["intent_summary_texts"]
ORACLES["search_indexed"] = ORACLES["search_text"]
