"""The catalogue's queries in SQL, for DuckDB over the same tables."""

from __future__ import annotations

from lexispark.functions.porter import stem_sql
from lexispark.functions.text import FIELD_SETS, STOP, model_name
from lexispark.operators.features import FEATURES
from lexispark.operators.index import FIELDS
from lexispark.operators.learning import ALPHAS, B, K1
from lexispark.operators.bitmaps import BUCKET
from lexispark.operators.blocks import BITS
from lexispark.operators.scoring import MODELS
from lexispark.plans.catalogue import ALPHA, BOOLEAN_QUERIES, DECISION, DEPTH, REPORT_CHANGES, SHORT_STOP, TOP_BITS, WEIGHTS

STOPS = ", ".join(f"'{w}'" for w in STOP)
SHORT_STOPS = ", ".join(f"'{w}'" for w in SHORT_STOP)
POSSESSIVE = r"regexp_replace(regexp_replace(lower({0}), '''s($|[^a-z])', '\1', 'g'), '''s($|[^a-z])', '\1', 'g')"
TERMS = "regexp_extract_all({0}, '[a-z0-9]+')"
PLAIN, NORMAL = TERMS.format("lower({0})"), TERMS.format(POSSESSIVE)
DOCS = "d AS (SELECT doc_id AS docid, string_split(coalesce(text, ''), chr(10))[1] AS title, array_to_string(string_split(coalesce(text, ''), ' ')[1:5], ' ') AS author, lang AS bibliography, coalesce(text, '') AS body FROM documents)"
LONG = "f AS (" + " UNION ALL ".join(f"SELECT docid, '{x}' AS field, coalesce({x}, '') AS text FROM d" for x in FIELDS) + ")"
TOK = f"tok AS (SELECT docid, field, term FROM (SELECT docid, field, unnest({PLAIN.format('text')}) AS term FROM f) WHERE term NOT IN ({STOPS}))"
TF = "tf AS (SELECT field, docid, term, count(*) AS tf FROM tok GROUP BY ALL)"
DF = "df AS (SELECT field, term, count(*) AS df FROM tf GROUP BY ALL)"
DL = "dl AS (SELECT f.field, f.docid, CAST(coalesce(l, 0) AS BIGINT) AS len FROM f LEFT JOIN (SELECT field, docid, sum(tf) AS l FROM tf GROUP BY ALL) c ON f.field = c.field AND f.docid = c.docid)"
STATS = "st AS (SELECT field, count(*) AS n, greatest(avg(len), 1e-12) AS avg, CAST(sum(len) AS BIGINT) AS tokens FROM dl GROUP BY field)"
TOPICS = f"q AS (SELECT item_id AS qid, text AS query FROM benchmark), qt AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({PLAIN.format('query')}) AS term FROM q) WHERE term NOT IN ({STOPS}) GROUP BY ALL), qn AS (SELECT q.qid, coalesce(n, 0) AS n FROM q LEFT JOIN (SELECT qid, count(*) AS n FROM qt GROUP BY qid) c ON q.qid = c.qid)"
INDEX = ", ".join((DOCS, LONG, TOK, TF, DF, DL, STATS, TOPICS))
#: Matches of one field.
MATCH = "m AS (SELECT qid, tf.docid, qt.term, qtf, tf, df, len, st.n, st.avg FROM qt JOIN tf ON qt.term = tf.term AND tf.field = 'body' JOIN df ON df.term = tf.term AND df.field = 'body' JOIN dl ON dl.docid = tf.docid AND dl.field = 'body' JOIN st ON st.field = 'body')"
QRELS = "j AS (SELECT qid, docid, CAST(1 + docid % 4 AS INTEGER) AS label FROM q JOIN d ON contains(d.body, q.query) WHERE query <> '')"


def r6(x: str) -> str:
    return f"round({x} + 1e-10::DOUBLE, 6) + 0.0"


def ranked(source: str, name: str = "rk") -> str:
    return f"{name} AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, docid) AS INTEGER) AS rank FROM {source})"


def weight(model: str, k1: str = "1.2::DOUBLE", b: str = "0.75::DOUBLE") -> str:
    norm = f"({k1} * (1 - {b} + {b} * len / avg))"
    sat = f"qtf * ({k1} * tf / (tf + {norm}))"
    return {
        "tf": "CAST(tf AS DOUBLE)",
        "tf_idf": f"{sat} * log2(n::DOUBLE / df + 1)",
        "lemur_tf_idf": f"{sat} * pow(log2(n::DOUBLE / df), 2)",
        "bm25_engine": f"log2((n - df + 0.5::DOUBLE) / (df + 0.5)) * (({k1} + 1) * tf / ({norm} + tf)) * (9.0::DOUBLE * qtf / (8.0 + qtf))",
        "bm25": f"ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5)) * ({k1} + 1) * tf / (tf + {norm})",
    }[model]


def scored(model: str) -> str:
    return f"s AS (SELECT qid, docid, sum({weight(model)}) AS score FROM m GROUP BY ALL)"


def cosine(field: str = "body", name: str = "s") -> str:
    w = f"{name}w AS (SELECT term, ln((n + 1)::DOUBLE / (df + 1)) + 1 AS idf FROM df JOIN st ON st.field = df.field WHERE df.field = '{field}')"
    d = f"{name}d AS (SELECT docid, tf.term, (1 + ln(tf)) * idf AS w FROM tf JOIN {name}w w ON w.term = tf.term WHERE tf.field = '{field}')"
    qq = f"{name}q AS (SELECT qid, qt.term, (1 + ln(qtf)) * idf AS qw FROM qt JOIN {name}w w ON w.term = qt.term)"
    return f"{w}, {d}, {qq}, {name} AS (SELECT x.qid, x.docid, dot / (dn * qn) AS score FROM (SELECT qid, docid, sum(w * qw) AS dot FROM {name}d d JOIN {name}q q ON d.term = q.term GROUP BY ALL) x JOIN (SELECT docid, sqrt(sum(w * w)) AS dn FROM {name}d GROUP BY docid) y ON x.docid = y.docid JOIN (SELECT qid, sqrt(sum(qw * qw)) AS qn FROM {name}q GROUP BY qid) z ON x.qid = z.qid)"


def top(source: str, k: int = 10) -> str:
    return f"WITH {INDEX}, {MATCH}, {source}, {ranked('s')} SELECT qid, docid, {r6('score')} AS score, rank FROM rk WHERE rank <= {k}"


ZONES = "z AS (SELECT h.qid, docid, " + ", ".join(f"{x}::DOUBLE / greatest(n, 1) AS {x}" for x in FIELDS) + " FROM (SELECT qid, docid, " + ", ".join(f"count(*) FILTER (field = '{x}') AS {x}" for x in FIELDS) + " FROM tf JOIN qt ON tf.term = qt.term GROUP BY ALL) h JOIN qn ON h.qid = qn.qid)"


def zone(weights: tuple[float, ...], any_term: bool = False) -> str:
    parts = [f"{w}::DOUBLE * " + (f"CASE WHEN {x} > 0 THEN 1.0::DOUBLE ELSE 0.0 END" if any_term else x) for x, w in zip(FIELDS, weights, strict=True)]
    return f"s AS (SELECT qid, docid, round({' + '.join(['0.0::DOUBLE', *parts])}, 12) AS score FROM z)"


def feature_sql(field: str, prefix: str = "") -> str:
    """CTEs that end in <prefix>ff: the features of one field."""
    hit = f"""{prefix}h AS (SELECT qid, tf.docid, len, tf::DOUBLE AS x_tf, ln((st.n + 1)::DOUBLE / (df + 1)) + 1 AS idf, tf::DOUBLE / greatest(len, 1) AS x_normalized_tf,
  tf * (ln((st.n + 1)::DOUBLE / (df + 1)) + 1) AS x_tfidf, ln(1 + (st.n - df + 0.5::DOUBLE) / (df + 0.5)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / st.avg)) AS bm
  FROM qt JOIN tf ON qt.term = tf.term AND tf.field = '{field}' JOIN df ON df.term = tf.term AND df.field = '{field}' JOIN dl ON dl.docid = tf.docid AND dl.field = '{field}' JOIN st ON st.field = '{field}')"""
    cols = ["matched::DOUBLE AS query_term_number", "matched::DOUBLE / qn.n AS query_term_ratio", "len::DOUBLE AS stream_length", "g.idf AS idf", "1.0::DOUBLE AS boolean", "v.score AS vector_space", "bm AS bm25"]
    aggs = []
    for x in ("tf", "normalized_tf", "tfidf"):
        aggs += [f"sum(x_{x}) AS {x}_s, min(x_{x}) AS {x}_l, max(x_{x}) AS {x}_h, sum(x_{x} * x_{x}) AS {x}_q"]
        cols += [f"{x}_s AS {x}_sum", f"CASE WHEN matched < qn.n THEN 0.0::DOUBLE ELSE {x}_l END AS {x}_min", f"{x}_h AS {x}_max", f"{x}_s / qn.n AS {x}_mean", f"greatest({x}_q / qn.n - ({x}_s / qn.n) * ({x}_s / qn.n), 0.0::DOUBLE) AS {x}_variance"]
    body = f"{prefix}ff AS (SELECT g.qid, g.docid, {', '.join(cols)} FROM (SELECT qid, docid, count(*) AS matched, any_value(len) AS len, sum(idf) AS idf, sum(bm) AS bm, {', '.join(aggs)} FROM {prefix}h GROUP BY qid, docid) g JOIN qn ON g.qid = qn.qid JOIN {prefix}v v ON v.qid = g.qid AND v.docid = g.docid)"
    return f"{cosine(field, prefix + 'v')}, {hit}, {body}"


def feature_matrix(field: str) -> str:
    return f"WITH {INDEX}, {feature_sql(field)} SELECT qid, docid, {', '.join(f'{r6(x)} AS {x}' for x in FEATURES)} FROM ff"


def feature_matrix_all() -> str:
    ctes = ", ".join(feature_sql(x, x) for x in FIELDS)
    pairs = " UNION ".join(f"SELECT qid, docid FROM {x}ff" for x in FIELDS)
    cols = []
    for x in FIELDS:
        for y in FEATURES:
            rest = f"(SELECT len::DOUBLE FROM dl WHERE dl.docid = p.docid AND dl.field = '{x}')" if y == "stream_length" else "0.0::DOUBLE"
            cols.append(f"{r6(f'coalesce({x}ff.{y}, {rest})')} AS {x}_{y}")
    joins = " ".join(f"LEFT JOIN {x}ff ON p.qid = {x}ff.qid AND p.docid = {x}ff.docid" for x in FIELDS)
    return f"WITH {INDEX}, {ctes}, p AS ({pairs}) SELECT p.qid, p.docid, {', '.join(cols)} FROM p {joins}"


def boolean(keep: tuple[int, ...], asked: str = "") -> str:
    """Answers of the fixed queries, or of those that ``asked`` selects."""
    rows = ", ".join(f"({i}, '{x.replace(chr(39), chr(39) * 2)}')" for i, x in BOOLEAN_QUERIES if i in keep)
    first = NORMAL.format("{0}") + "[1]"
    voc = f"voc AS (SELECT DISTINCT term FROM (SELECT unnest({NORMAL.format('body')}) AS term FROM d) WHERE term NOT IN ({STOPS}) UNION SELECT l FROM p UNION SELECT r FROM p)"
    return f"""WITH {DOCS}, bq AS ({asked or f'SELECT * FROM (VALUES {rows}) v(query_id, query)'}),
p AS (SELECT query_id, upper(w[2]) AS op, coalesce({first.format("w[1]")}, '') AS l, coalesce({first.format("w[3]")}, '') AS r FROM (SELECT query_id, regexp_split_to_array(trim(query), '\\s+') AS w FROM bq) WHERE len(w) = 3 AND upper(w[2]) IN ('AND', 'OR')),
{voc}, {stem_sql("voc", "porter_all")},
post AS (SELECT DISTINCT stem, docid FROM (SELECT docid, unnest({NORMAL.format("body")}) AS term FROM d) t JOIN stems USING (term) WHERE t.term NOT IN ({STOPS})),
x AS (SELECT query_id, op, a.stem AS "left", b.stem AS "right" FROM p JOIN stems a ON a.term = l JOIN stems b ON b.term = r),
h AS (SELECT query_id, docid FROM x JOIN post ON stem IN (x."left", x."right") GROUP BY query_id, op, "left", "right", docid HAVING op = 'OR' OR count(*) = CASE WHEN "left" = "right" THEN 1 ELSE 2 END)
SELECT CAST(x.query_id AS BIGINT) AS query_id, op, "left", "right", count(docid) AS n, coalesce(string_agg(CAST(docid AS VARCHAR), ' ' ORDER BY docid), '') AS docids FROM x LEFT JOIN h ON x.query_id = h.query_id GROUP BY ALL"""


STEMMED = f"vt AS (SELECT docid, term FROM (SELECT docid, unnest({NORMAL.format('body')}) AS term FROM d) WHERE term NOT IN ({STOPS})), voc AS (SELECT DISTINCT term FROM vt), {stem_sql('voc', 'porter_all')}, sp AS (SELECT DISTINCT stem AS term, docid FROM vt JOIN stems USING (term))"
RUN = f"{INDEX}, {MATCH}, {scored('bm25')}, {ranked('s', 'r0')}, run AS (SELECT * FROM r0 WHERE rank <= {DEPTH}), {QRELS}"
PRF = """rel AS (SELECT q.qid, count(j.docid) AS relevant FROM q LEFT JOIN j ON q.qid = j.qid GROUP BY q.qid),
prf AS (SELECT rel.qid, k, hits::DOUBLE / k AS p, CASE WHEN relevant > 0 THEN hits::DOUBLE / relevant ELSE 0.0 END AS r FROM
  (SELECT rel.qid, relevant, k, (SELECT count(*) FROM run JOIN j ON run.qid = j.qid AND run.docid = j.docid WHERE run.qid = rel.qid AND rank <= k) AS hits FROM rel, (VALUES (5), (10), (20), (50), (100)) c(k)) rel),
pf AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f1 FROM prf)"""


def measured(run: str = "run", name: str = "ms") -> str:
    """CTE <name>: the measures of a run by topic."""
    return f"""{name}_l AS (SELECT run.qid, rank, coalesce(label, 0) AS label, sum(CASE WHEN label > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY run.qid ORDER BY rank) AS seen FROM {run} run LEFT JOIN j ON run.qid = j.qid AND run.docid = j.docid),
{name}_g AS (SELECT qid, sum(CASE WHEN label > 0 THEN seen::DOUBLE / rank ELSE 0 END) AS ap, sum(CASE WHEN rank <= 10 THEN label / log2(rank + 1) ELSE 0 END) AS d10, sum(CASE WHEN rank <= 20 THEN label / log2(rank + 1) ELSE 0 END) AS d20,
  count(*) FILTER (rank <= 5 AND label > 0) AS h5, count(*) FILTER (rank <= 10 AND label > 0) AS h10, count(*) FILTER (rank <= 100 AND label > 0) AS h100, min(CASE WHEN label > 0 THEN rank END) AS first FROM {name}_l GROUP BY qid),
{name}_i AS (SELECT qid, count(*) AS relevant, sum(CASE WHEN i <= 10 THEN label / log2(i + 1) ELSE 0 END) AS i10, sum(CASE WHEN i <= 20 THEN label / log2(i + 1) ELSE 0 END) AS i20 FROM (SELECT qid, label, row_number() OVER (PARTITION BY qid ORDER BY label DESC) AS i FROM j) GROUP BY qid),
{name} AS (SELECT q.qid, coalesce(ap / relevant, 0.0::DOUBLE) AS ap, coalesce(d10 / i10, 0.0::DOUBLE) AS ndcg_10, coalesce(d20 / i20, 0.0::DOUBLE) AS ndcg_20, coalesce(h5::DOUBLE / 5, 0.0::DOUBLE) AS p_5, coalesce(h10::DOUBLE / 10, 0.0::DOUBLE) AS p_10, coalesce(h100::DOUBLE / relevant, 0.0::DOUBLE) AS r_100, coalesce(1.0::DOUBLE / first, 0.0::DOUBLE) AS rr
  FROM q LEFT JOIN {name}_g g ON q.qid = g.qid LEFT JOIN {name}_i i ON q.qid = i.qid)"""


def measure(column: str) -> str:
    return f"WITH {RUN}, {measured()} SELECT qid, {r6(column)} AS {column} FROM ms"


ALL_MEASURES = f"WITH {RUN}, {measured()} SELECT qid, {', '.join(f'{r6(c)} AS {c}' for c in ('ap', 'ndcg_10', 'ndcg_20', 'p_5', 'p_10', 'r_100', 'rr'))} FROM ms"
SIMPLEX = "gr AS (SELECT CAST((i * 11 + j) * 11 + k AS BIGINT) AS g, i / 10::DOUBLE AS a, j / 10::DOUBLE AS b, k / 10::DOUBLE AS c, (10 - i - j - k) / 10::DOUBLE AS d FROM range(0, 11) x(i), range(0, 11) y(j), range(0, 11) w(k) WHERE i + j + k <= 10)"
PADDED = f"WITH {INDEX}, {ZONES}, {zone(WEIGHTS)}, al AS (SELECT q.qid, d.docid, coalesce(s.score, 0.0::DOUBLE) AS score FROM q CROSS JOIN d LEFT JOIN s ON s.qid = q.qid AND s.docid = d.docid), {ranked('al')}"


def zone_grid(any_term: bool) -> str:
    v = [f"CASE WHEN {x} > 0 THEN 1.0::DOUBLE ELSE 0.0 END" if any_term else x for x in FIELDS]
    total = " + ".join(["0.0::DOUBLE", *(f"gr.{w} * ({x})" for w, x in zip("abcd", v, strict=True))])
    return f"""WITH {INDEX}, {ZONES}, {QRELS}, {SIMPLEX},
gs AS (SELECT g, qid, docid, round({total}, 12) AS score FROM z CROSS JOIN gr),
gk AS (SELECT g, qid, docid, row_number() OVER (PARTITION BY g, qid ORDER BY score DESC, docid) AS rank FROM gs WHERE score > 0),
gh AS (SELECT g, gk.qid, count(*) AS hits FROM gk JOIN j ON gk.qid = j.qid AND gk.docid = j.docid WHERE rank <= 10 GROUP BY ALL),
gf AS (SELECT g, sum(2 * (hits / 10::DOUBLE) * (hits::DOUBLE / relevant) / (hits / 10::DOUBLE + hits::DOUBLE / relevant)) / (SELECT count(*) FROM q) AS f1 FROM gh JOIN (SELECT qid, count(*) AS relevant FROM j GROUP BY qid) t ON gh.qid = t.qid GROUP BY g),
gz AS (SELECT gr.*, coalesce(f1, 0.0::DOUBLE) AS f1 FROM gr LEFT JOIN gf ON gr.g = gf.g)"""


BM25_GRID = f"""WITH {INDEX}, {MATCH}, {QRELS}, gr AS (SELECT CAST(i * {len(B)} + k AS INTEGER) AS g, k1, b FROM (SELECT unnest([{", ".join(map(str, K1))}])::DOUBLE AS k1, unnest(range(0, {len(K1)})) AS i), (SELECT unnest([{", ".join(map(str, B))}])::DOUBLE AS b, unnest(range(0, {len(B)})) AS k)),
gs AS (SELECT g, qid, docid, sum({weight("bm25", "k1", "b")}) AS score FROM m CROSS JOIN gr WHERE qid % 2 = 1 GROUP BY ALL),
gk AS (SELECT g, qid, docid, row_number() OVER (PARTITION BY g, qid ORDER BY round(score, 9) DESC, docid) AS rank FROM gs),
gh AS (SELECT g, gk.qid, rank, row_number() OVER (PARTITION BY g, gk.qid ORDER BY rank) AS seen FROM gk JOIN j ON gk.qid = j.qid AND gk.docid = j.docid WHERE rank <= 1000),
ga AS (SELECT g, sum(s / relevant) / (SELECT count(*) FROM q WHERE qid % 2 = 1) AS ap FROM (SELECT g, qid, sum(seen::DOUBLE / rank) AS s FROM gh GROUP BY ALL) x JOIN (SELECT qid, count(*) AS relevant FROM j GROUP BY qid) t ON x.qid = t.qid GROUP BY g)
SELECT gr.g, k1, b, {r6("coalesce(ap, 0.0::DOUBLE)")} AS ap FROM gr LEFT JOIN ga ON gr.g = ga.g"""

LINE = "concat_ws(' ', {0}, 'Q0', docid, rank, printf('%.6f', score), 'lexispark')"


def stemmed_top() -> str:
    plain = INDEX.replace("tok AS (", "tk0 AS (", 1)
    voc = f"voc AS (SELECT DISTINCT term FROM tk0 UNION SELECT DISTINCT term FROM qt0), {stem_sql('voc', 'porter')}"
    topics = TOPICS.replace("qt AS (", "qt0 AS (").split(", qn AS")[0]
    qt = "qt AS (SELECT qid, stem AS term, CAST(sum(qtf) AS BIGINT) AS qtf FROM qt0 JOIN stems USING (term) GROUP BY ALL)"
    head = ", ".join((DOCS, LONG, TOK.replace("tok AS (", "tk0 AS ("), topics, voc, "tok AS (SELECT docid, field, stem AS term FROM tk0 JOIN stems USING (term))", qt, TF, DF, DL, STATS))
    assert plain
    return f"WITH {head}, {MATCH}, {scored('bm25')}, {ranked('s')} SELECT qid, docid, {r6('score')} AS score, rank FROM rk WHERE rank <= 10"


def grid_stats() -> str:
    voc = f"voc AS (SELECT DISTINCT term FROM t0), {stem_sql('voc', 'weak', 'wk')}, {stem_sql('voc', 'porter', 'pt')}"
    sets = ", ".join(f"('{s}', '{x}')" for s, xs in FIELD_SETS.items() for x in xs)
    return f"""WITH {DOCS}, {LONG}, t0 AS (SELECT docid, field, unnest({PLAIN.format("text")}) AS term FROM f), {voc},
st3 AS (SELECT term, 'none' AS stemmer, term AS stem FROM voc UNION ALL SELECT term, 'weak', stem FROM wk UNION ALL SELECT term, 'porter', stem FROM pt),
x AS (SELECT fields, stemmer, stop, stem, docid, count(*) AS tf FROM t0 JOIN (VALUES {sets}) fs(fields, field) ON t0.field = fs.field JOIN st3 ON st3.term = t0.term CROSS JOIN (VALUES ('none'), ('list'), ('short')) sl(stop) WHERE stop = 'none' OR stop = 'list' AND t0.term NOT IN ({STOPS}) OR stop = 'short' AND t0.term NOT IN ({SHORT_STOPS}) GROUP BY ALL)
SELECT concat_ws('__', fields, stemmer, stop) AS variant, (SELECT count(*) FROM d) AS docs, count(DISTINCT stem) AS terms, count(*) AS postings, CAST(sum(tf) AS BIGINT) AS tokens, round(sum(tf) / (SELECT count(*) FROM d)::DOUBLE, 2) AS avg FROM x GROUP BY fields, stemmer, stop"""


def grid_measures() -> str:
    """Measures of every variant; a topic of a variant is named by both."""
    voc = f"voc AS (SELECT DISTINCT term FROM t0 UNION SELECT DISTINCT term FROM qr), {stem_sql('voc', 'weak', 'wk')}, {stem_sql('voc', 'porter', 'pt')}"
    sets = ", ".join(f"('{s}', '{x}')" for s, xs in FIELD_SETS.items() for x in xs)
    kept = f"(stop = 'none' OR stop = 'list' AND {{0}} NOT IN ({STOPS}) OR stop = 'short' AND {{0}} NOT IN ({SHORT_STOPS}))"
    means = ", ".join(f"{r6(f'avg({c})')} AS {c}" for c in ("ap", "ndcg_10", "ndcg_20", "p_5", "p_10", "r_100", "rr"))
    return f"""WITH {DOCS}, {LONG}, t0 AS (SELECT docid, field, unnest({PLAIN.format("text")}) AS term FROM f),
q0 AS (SELECT item_id AS qid, text AS query FROM benchmark), qr AS (SELECT qid, unnest({PLAIN.format("query")}) AS term FROM q0), {voc},
st3 AS (SELECT term, 'none' AS stemmer, term AS stem FROM voc UNION ALL SELECT term, 'weak', stem FROM wk UNION ALL SELECT term, 'porter', stem FROM pt),
sl(stop) AS (VALUES ('none'), ('list'), ('short')), fs(fields, field) AS (VALUES {sets}),
x AS (SELECT fields, stemmer, stop, stem, docid, count(*) AS tf FROM t0 JOIN fs ON t0.field = fs.field JOIN st3 ON st3.term = t0.term CROSS JOIN sl WHERE {kept.format("t0.term")} GROUP BY ALL),
vr AS (SELECT DISTINCT fields, stemmer, stop, concat_ws('__', fields, stemmer, stop) AS variant FROM fs, sl, (VALUES ('none'), ('weak'), ('porter')) s(stemmer)),
vl AS (SELECT fields, stop, docid, sum(tf) AS l FROM x WHERE stemmer = 'none' GROUP BY ALL),
dlv AS (SELECT c.fields, c.stop, d.docid, CAST(coalesce(l, 0) AS BIGINT) AS len FROM d CROSS JOIN (SELECT DISTINCT fields, stop FROM vr) c LEFT JOIN vl ON vl.fields = c.fields AND vl.stop = c.stop AND vl.docid = d.docid),
av AS (SELECT fields, stop, count(*) AS n, greatest(avg(len), 1e-12) AS avg FROM dlv GROUP BY ALL),
dfv AS (SELECT fields, stemmer, stop, stem, count(*) AS df FROM x GROUP BY ALL),
qv AS (SELECT stemmer, stop, qid, stem, count(*) AS qtf FROM qr JOIN st3 ON st3.term = qr.term CROSS JOIN sl WHERE {kept.format("qr.term")} GROUP BY ALL),
m AS (SELECT variant || '|' || qid AS qid, docid, qtf, tf, df, len, n, avg FROM qv JOIN x USING (stemmer, stop, stem) JOIN dfv USING (fields, stemmer, stop, stem) JOIN dlv USING (fields, stop, docid) JOIN av USING (fields, stop) JOIN vr USING (fields, stemmer, stop)),
{scored("bm25_engine")}, {ranked("s", "r0")}, run AS (SELECT * FROM r0 WHERE rank <= 1000),
j0 AS (SELECT qid, docid, CAST(1 + docid % 4 AS INTEGER) AS label FROM q0 JOIN d ON contains(d.body, q0.query) WHERE query <> ''),
q AS (SELECT variant || '|' || qid AS qid FROM q0, vr), j AS (SELECT variant || '|' || qid AS qid, docid, label FROM j0, vr), {measured()},
g AS (SELECT split_part(qid, '|', 1) AS name, {", ".join(f"avg({c}) AS {c}" for c in ("ap", "ndcg_10", "ndcg_20", "p_5", "p_10", "r_100", "rr"))} FROM ms GROUP BY ALL)
SELECT name, CAST(row_number() OVER (ORDER BY round(ap, 12) DESC, name) AS INTEGER) AS place, {means.replace("avg(", "(")} FROM g"""


#: The two-sided p of t with v degrees of freedom by its finite sum of powers of a cosine, for odd and even v, and the exact sign test.
T_TEST = """CASE WHEN t IS NULL THEN NULL WHEN t = 0 THEN 1.0::DOUBLE ELSE greatest(1 - CASE WHEN v % 2 = 1
  THEN 2 / pi() * (th + CASE WHEN v > 1 THEN sin(th) * list_sum(list_transform(range(0, (v - 1) // 2), lambda i: pow(cos(th), 2 * i + 1) * list_product(list_transform(range(1, i + 1), lambda x: 2.0::DOUBLE * x / (2 * x + 1)) || [1.0::DOUBLE]))) ELSE 0 END)
  ELSE sin(th) * list_sum(list_transform(range(0, v // 2), lambda i: pow(cos(th), 2 * i) * list_product(list_transform(range(1, i + 1), lambda x: (2 * x - 1.0::DOUBLE) / (2 * x)) || [1.0::DOUBLE]))) END, 0.0::DOUBLE) END"""
SIGN_TEST = "least(1.0::DOUBLE, 2 * list_sum(list_transform(range(0, least(better, worse) + 1), lambda i: exp(lgamma(better + worse + 1) - lgamma(i + 1) - lgamma(better + worse - i + 1) - (better + worse) * ln(2)))))"


def tuned() -> str:
    """The best setting on odd topics against the defaults, by measure."""
    grid = BM25_GRID[: BM25_GRID.rindex("SELECT gr.g")].rstrip()
    names = {"AP": "ap", "nDCG@10": "ndcg_10", "nDCG@20": "ndcg_20", "P@5": "p_5", "P@10": "p_10", "R@100": "r_100", "RR": "rr"}
    runs = []
    for name, k1, b in (("a", "1.2::DOUBLE", "0.75::DOUBLE"), ("b", "k1", "b")):
        runs += [f"s{name} AS (SELECT qid, docid, sum({weight('bm25', k1, b)}) AS score FROM m, best GROUP BY ALL)", ranked(f"s{name}", f"k{name}"), f"run{name} AS (SELECT * FROM k{name} WHERE rank <= 1000)", measured(f"run{name}", f"m{name}")]
    long = " UNION ALL ".join(f"SELECT ma.qid, '{m}' AS measure, ma.{c} AS x, mb.{c} AS y FROM ma JOIN mb USING (qid)" for m, c in names.items())
    return f"""{grid},
best AS (SELECT gr.k1, gr.b FROM gr LEFT JOIN ga ON gr.g = ga.g ORDER BY round(coalesce(ap, 0.0), 12) DESC, gr.g LIMIT 1),
{", ".join(runs)}, l AS ({long}), sets AS (SELECT 'full' AS set, qid FROM q UNION ALL SELECT 'heldout', qid FROM q WHERE qid % 2 = 0),
c AS (SELECT set, measure, count(*) AS topics, avg(x) AS baseline, avg(y) AS other, count(*) FILTER (round(y - x, 12) > 0) AS better, count(*) FILTER (round(y - x, 12) < 0) AS worse, avg(round(y - x, 12)) AS mean, stddev_samp(round(y - x, 12)) AS sd FROM l JOIN sets USING (qid) GROUP BY ALL),
t AS (SELECT *, CASE WHEN sd > 1e-12 THEN mean / (sd / sqrt(topics)) END AS t, topics - 1 AS v FROM c), u AS (SELECT *, atan(abs(t) / sqrt(v)) AS th FROM t)
SELECT set, measure, topics, {r6("baseline")} AS baseline, {r6("other")} AS other, better, worse, {r6("t")} AS t, {r6(T_TEST)} AS p, {r6(SIGN_TEST)} AS sign_p, k1, b FROM u, best"""


#: A posting's part of BM25 without the topic.
PLACED = "pl AS (SELECT tf.term, tf.docid, tf.docid >> {0} AS block, 2.2::DOUBLE * tf / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / st.avg)) AS w FROM tf JOIN dl ON dl.docid = tf.docid AND dl.field = 'body' JOIN st ON st.field = 'body' WHERE tf.field = 'body')"


def skipped(k: int = 10) -> str:
    """Blocks of a topic's terms whose span's bounds stay below the k-th best score among documents of the rarest term."""
    return f"""WITH {INDEX}, {MATCH}, {PLACED.format(TOP_BITS)}, {scored("bm25")},
a AS (SELECT qid, qt.term, df, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5)) AS idf FROM qt JOIN df ON df.field = 'body' AND df.term = qt.term JOIN st ON st.field = 'body'),
b AS (SELECT qid, block, idf * max(w) AS most FROM a JOIN pl USING (term) GROUP BY qid, term, block, idf),
rare AS (SELECT qid, arg_min(term, (df, term)) AS term FROM a WHERE df >= {k} GROUP BY qid),
c AS (SELECT s.qid, score, row_number() OVER (PARTITION BY s.qid ORDER BY round(score, 9) DESC, s.docid) AS rank FROM s JOIN rare ON rare.qid = s.qid JOIN pl ON pl.term = rare.term AND pl.docid = s.docid),
sp AS (SELECT qid, block, sum(most) AS most, count(*) AS lists FROM b GROUP BY ALL)
SELECT sp.qid, CAST(sum(lists) AS BIGINT) AS blocks, CAST(sum(CASE WHEN most >= coalesce(score, 0) - 2e-9 THEN 0 ELSE lists END) AS BIGINT) AS skipped FROM sp LEFT JOIN c ON c.qid = sp.qid AND c.rank = {k} GROUP BY sp.qid"""


def scaled() -> str:
    """Mean and deviation of each feature over all pairs of training topics and documents."""
    ctes, parts = ", ".join(feature_sql(x, x) for x in FIELDS), []
    for x in FIELDS:
        sums = ", ".join(f"{{'feature': '{x}.{y}', 's': coalesce(sum({y}), 0.0::DOUBLE), 'q': coalesce(sum({y} * {y}), 0.0::DOUBLE)}}" for y in FEATURES if y != "stream_length")
        parts.append(f"SELECT unnest([{sums}], recursive := true) FROM {x}ff WHERE qid % 5 < 3")
        parts.append(f"SELECT '{x}.stream_length', sum(len)::DOUBLE * any_value(t), sum(len * len)::DOUBLE * any_value(t) FROM dl, (SELECT count(*) AS t FROM q WHERE qid % 5 < 3) WHERE field = '{x}'")
    return f"""WITH {INDEX}, {ctes}, sm AS ({" UNION ALL ".join(parts)}), pn AS (SELECT (SELECT count(*) FROM q WHERE qid % 5 < 3) * (SELECT count(*) FROM d) AS n)
SELECT feature, round(s / n + 1e-10::DOUBLE, 5) + 0.0 AS mean, round(sqrt(greatest(q / n - (s / n) * (s / n), 0.0::DOUBLE)) + 1e-10::DOUBLE, 5) + 0.0 AS deviation FROM sm, pn"""


def decision() -> str:
    """The first ten of all pairs by fixed weights."""
    ctes = ", ".join(feature_sql(x, x) for x in FIELDS)
    terms = []
    for x in FIELDS:
        for y, w in DECISION.items():
            terms.append(f"{w}::DOUBLE * " + (f"(SELECT len FROM dl WHERE dl.docid = d.docid AND dl.field = '{x}')" if y == "stream_length" else f"coalesce({x}ff.{y}, 0.0::DOUBLE)"))
    joins = " ".join(f"LEFT JOIN {x}ff ON q.qid = {x}ff.qid AND d.docid = {x}ff.docid" for x in FIELDS)
    return f"WITH {INDEX}, {ctes}, s AS (SELECT q.qid, d.docid, {' + '.join(terms)} - 0.5::DOUBLE AS score FROM q CROSS JOIN d {joins}), {ranked('s')} SELECT qid, docid, {r6('score')} AS score, rank FROM rk WHERE rank <= 10"


def contributions() -> str:
    """Fixed weights times the means of their features over all matches, the three of the largest size."""
    ctes, pairs = ", ".join(feature_sql(x, x) for x in FIELDS), " UNION ".join(f"SELECT qid, docid FROM {x}ff" for x in FIELDS)
    joins = " ".join(f"LEFT JOIN {x}ff ON p.qid = {x}ff.qid AND p.docid = {x}ff.docid" for x in FIELDS)
    rows = []
    for x in FIELDS:
        for y, w in DECISION.items():
            rest = f"(SELECT len::DOUBLE FROM dl WHERE dl.docid = p.docid AND dl.field = '{x}')" if y == "stream_length" else "0.0::DOUBLE"
            rows.append(f"SELECT '{x}.{y}' AS feature, {w}::DOUBLE * avg(coalesce({x}ff.{y}, {rest})) AS weight FROM p {joins}")
    return f"WITH {INDEX}, {ctes}, p AS ({pairs}), w AS ({' UNION ALL '.join(rows)}) SELECT feature, {r6('weight')} AS weight FROM w ORDER BY abs(round(weight, 12)) DESC, feature LIMIT 3"


#: Documents and labels made faulty as the query does, and their faults.
FAULTS = f"""WITH {DOCS}, c AS (SELECT CASE WHEN docid % 50 = 7 THEN NULL WHEN docid % 50 = 3 THEN docid - 1 ELSE docid END AS id, CASE WHEN docid % 40 = 5 THEN '' ELSE trim(regexp_replace(body, '\\s+', ' ', 'g')) END AS t FROM d),
x AS (SELECT doc_id AS x FROM labels UNION ALL SELECT doc_id FROM labels WHERE doc_id % 7 = 0),
g AS (SELECT x % 50 AS qid, x * 2 AS docid, x % 8 - 1 AS code FROM x WHERE x % 10 <> 0)
SELECT 'collection' AS source, unnest(['rows', 'unnumbered', 'empty', 'repeated']) AS fault, unnest([count(*), count(*) FILTER (id IS NULL), count(*) FILTER (t = ''), count(id) - count(DISTINCT id)]) AS n FROM c
UNION ALL SELECT 'judgements', unnest(['rows', 'malformed', 'unknown_code', 'unknown_topic', 'unknown_document', 'repeated']), unnest([(SELECT count(*) FROM x), (SELECT count(*) FROM x WHERE x % 10 = 0),
  count(*) FILTER (code NOT IN (-1, 1, 2, 3, 4, 5)), count(*) FILTER (qid NOT IN (SELECT item_id FROM benchmark)), count(*) FILTER (docid NOT IN (SELECT doc_id FROM documents)), count(*) - count(DISTINCT (qid, docid))]) FROM g"""


def models(names: tuple[str, ...] = ("tf", "tf_idf", "bm25")) -> str:
    """CTE mt: models with the means of their measures, and their places."""
    ctes, rows = [], []
    for m in names:
        ctes += [cosine(name=f"{m}s") if m == "cosine" else scored(m).replace("s AS", f"{m}s AS", 1), ranked(f"{m}s", f"{m}k"), f"{m}r AS (SELECT * FROM {m}k WHERE rank <= {DEPTH})", measured(f"{m}r", f"{m}m")]
        name = model_name(m, {"k_1": 1.2, "b": 0.75}) if m.startswith("bm25") else m
        rows.append(f"SELECT '{name}' AS name, avg(ap) AS ap, avg(ndcg_10) AS ndcg_10, avg(p_10) AS p_10, avg(rr) AS rr, (SELECT count(*) FROM {m}r) AS rows FROM {m}m")
    return f"WITH {INDEX}, {MATCH}, {QRELS}, {', '.join(ctes)}, mt AS (SELECT *, CAST(row_number() OVER (ORDER BY round(ap, 12) DESC, name) AS INTEGER) AS place FROM ({' UNION ALL '.join(rows)}))"


def report() -> str:
    """The lines of the models' table."""
    cells = []
    for c, places in REPORT_CHANGES["decimals"].items():
        x = {"AP": "ap", "nDCG@10": "ndcg_10", "P@10": "p_10", "RR": "rr"}.get(c, c)
        cell = f"CAST({x} AS VARCHAR)" if places < 0 else f"printf('%.{places}f', round({x} + 1e-10::DOUBLE, {places}))"
        if c in ("AP", "nDCG@10"):
            cell += f" || CASE WHEN avg({x}) OVER () <> 0 THEN printf(' (%+.1f%%)', 100 * ({x} - avg({x}) OVER ()) / avg({x}) OVER ()) ELSE '' END"
        cells.append(cell)
    line, names = " || ' | ' || ".join(cells), " | ".join(REPORT_CHANGES["decimals"])
    kinds = "".join(" --- |" if p < 0 else " ---: |" for p in REPORT_CHANGES["decimals"].values())
    return f"{models(MODELS)} SELECT CAST(place AS BIGINT) AS place, '| ' || {line} || ' |' AS line FROM mt UNION ALL SELECT CAST(-1 AS BIGINT), '| {names} |' UNION ALL SELECT CAST(0 AS BIGINT), '|{kinds}'"


def forms() -> str:
    """What the three readers take of a file with text beside tags and tags after the body."""
    flat = r"regexp_replace(trim(regexp_replace(coalesce({0}, ''), '\s+', ' ', 'g')), '^\.', '·')"
    title, author, lang, body = (flat.format(x) for x in FIELDS)
    of = {
        "merged": (["''"], [author, "'.B extra'", lang], ["''"], [body, "'.A tail'", "'.T again'"]),
        "strict": ([title], [author], [lang], [body, "'tail'", "'again'"]),
        "fielded": (["'in ' || " + lang, title, "'again'"], [author], ["'extra'", lang], [body, "'tail'"]),
    }
    rows = []
    for form, parts in of.items():
        cols = [f"array_to_string(list_filter([{', '.join(p)}], lambda x: x <> ''), ' ') AS {f}" for f, p in zip(FIELDS, parts, strict=True)]
        rows.append(f"SELECT '{form}' AS form, docid, {', '.join(cols)} FROM d")
    sizes = ", ".join(f"CAST(strlen({f}) AS BIGINT) AS {f}" for f in FIELDS)
    return f"WITH {DOCS}, r AS ({' UNION ALL '.join(rows)}) SELECT form, docid, {sizes}, sha256({' || chr(124) || '.join(FIELDS)}) AS digest FROM r"


def more() -> dict[str, str]:
    """Queries over written files, runs, splits and tables of results."""
    idx = f"WITH {INDEX}"
    flat = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
    two = [f"{scored(m).replace('s AS', f'{m}s AS', 1)}, {ranked(f'{m}s', f'{m}k')}" for m in ("bm25", "tf")]
    split = "sp3 AS (SELECT item_id AS qid, CASE WHEN item_id % 5 < 3 THEN 'train' WHEN item_id % 5 = 3 THEN 'validation' ELSE 'test' END AS split FROM benchmark)"
    lines = "unnest(['Query: ' || trim(query), 'Stemmed query: ' || \"left\" || ' ' || op || ' ' || \"right\", 'Matched documents: ' || n, docids])"
    asked = ", ".join(f"({i}, '{x.replace(chr(39), chr(39) * 2)}')" for i, x in BOOLEAN_QUERIES)
    return {
        "svm_scaler": scaled(),
        "svm_class_counts": f"{idx}, {QRELS}, n AS (SELECT (SELECT count(*) FROM q WHERE qid % 5 < 3) * (SELECT count(*) FROM d) AS pairs, (SELECT count(*) FROM j WHERE qid % 5 < 3) AS good) SELECT label, CAST(p AS BIGINT) AS pairs, {r6('pairs / 2::DOUBLE')} AS weight FROM (SELECT 1.0::DOUBLE AS label, good AS p, pairs FROM n UNION ALL SELECT 0.0::DOUBLE, pairs - good, pairs FROM n)",
        "linear_decision": decision(),
        "collection_file": f"WITH {DOCS} SELECT docid, " + ", ".join(f"CAST(strlen(regexp_replace({flat.format(x)}, '^\\.', '·')) AS BIGINT) AS {x}" for x in FIELDS) + " FROM d",
        "processed_file": f"WITH {DOCS}, m AS (SELECT docid, title || ' ' || body AS t FROM d) SELECT docid, array_to_string(list_filter({NORMAL.format('t')}, lambda x: x NOT IN ({STOPS})), ' ') AS tokens FROM m",
        "index_file": f"WITH {DOCS}, {STEMMED} SELECT term, docid FROM sp",
        "index_lookup": f"{idx}, b AS (SELECT term, df FROM df WHERE field = 'body'), w AS ((SELECT term FROM b ORDER BY df DESC, term LIMIT 3) UNION (SELECT term FROM b ORDER BY df, term LIMIT 3)) SELECT tf.term, docid, tf FROM tf JOIN w ON w.term = tf.term WHERE field = 'body'",
        "boolean_bitmaps": f"""{idx}, w AS (SELECT term, row_number() OVER (ORDER BY df DESC, term) AS nr FROM df WHERE field = 'body' ORDER BY nr LIMIT 12),
p AS (SELECT a.nr, a.term AS "left", b.term AS "right", op, i FROM w a JOIN w b ON b.nr = a.nr + 1, (VALUES ('AND', 0), ('OR', 1)) o(op, i)),
h AS (SELECT nr, i, docid, CASE WHEN docid > 0 THEN 1 + (docid - 1) // {BUCKET} ELSE docid // {BUCKET} END AS bucket FROM p JOIN tf ON field = 'body' AND tf.term IN ("left", "right") GROUP BY ALL HAVING any_value(i) = 1 OR count(*) = 2)
SELECT 2 * p.nr + p.i AS query_id, op, "left", "right", bucket, docid, count(*) OVER (PARTITION BY p.nr, p.i, bucket) AS n FROM p JOIN h ON h.nr = p.nr AND h.i = p.i""",
        "model_stage": decision(),
        "fault_counts": FAULTS,
        "boolean_common": f"""{idx}, w AS (SELECT term, row_number() OVER (ORDER BY df DESC, term) AS nr FROM df WHERE field = 'body' ORDER BY nr LIMIT 12),
p AS (SELECT a.nr, a.term AS "left", b.term AS "right", op, i FROM w a JOIN w b ON b.nr = a.nr + 1, (VALUES ('AND', 0), ('OR', 1)) o(op, i)),
h AS (SELECT nr, i, docid FROM p JOIN tf ON field = 'body' AND tf.term IN ("left", "right") GROUP BY ALL HAVING i = 1 OR count(*) = 2)
SELECT 2 * p.nr + p.i AS query_id, op, "left", "right", count(docid) AS n, coalesce(string_agg(CAST(docid AS VARCHAR), ' ' ORDER BY docid), '') AS docids FROM p LEFT JOIN h ON h.nr = p.nr AND h.i = p.i GROUP BY ALL""",
        "posting_blocks": f"{idx}, {PLACED.format(BITS)} SELECT term, block, CAST(count(*) AS INTEGER) AS n, min(docid) AS first, max(docid) AS last, string_agg(CAST(docid AS VARCHAR), ',' ORDER BY docid) AS docids, {r6('max(w)')} AS bound FROM pl GROUP BY term, block",
        "top_by_bounds": top(scored("bm25")),
        "blocks_skipped": skipped(),
        "reader_forms": forms(),
        "stop_list_file": f"WITH {DOCS}, t AS (SELECT docid, {PLAIN.format('body')} AS t FROM d), w AS (SELECT list(term) AS w FROM (SELECT term, count(DISTINCT docid) AS df FROM (SELECT docid, unnest(t) AS term FROM t) GROUP BY term ORDER BY df DESC, term LIMIT 25)) SELECT docid, CAST(len(t) AS BIGINT) AS tokens, array_to_string(list_filter(t, lambda x: NOT list_contains(w.w, x)), ' ') AS kept FROM t, w",
        "boolean_query_file": boolean((), "SELECT row_number() OVER (ORDER BY item_id) AS query_id, w[1] || CASE WHEN item_id % 2 = 0 THEN ' and ' ELSE ' OR ' END || w[2] AS query FROM (SELECT item_id, string_split(" + flat.format("coalesce(text, '')") + ", ' ') AS w FROM benchmark) WHERE item_id % 5 <> 0 AND len(w) > 1"),
        "index_order": f"WITH {DOCS}, {STEMMED}, v AS (SELECT DISTINCT term FROM sp) SELECT CAST(1 AS BIGINT) AS place, count(DISTINCT term) || ', ' || coalesce(max(docid), 0) AS term FROM sp UNION ALL SELECT 1 + row_number() OVER (ORDER BY term), term FROM v",
        "model_report": report(),
        "model_times": f"{models(MODELS)} SELECT CASE WHEN contains(name, '(') THEN split_part(name, '(', 1) ELSE name END AS model, rows, true AS timed FROM mt",
        "refit_certificate": f"{idx}, {QRELS} SELECT {ALPHA!r}::DOUBLE AS alpha, true AS optimal, (SELECT count(*) FROM q WHERE qid % 5 < 4) * (SELECT count(*) FROM d) AS pairs, (SELECT count(*) FROM j WHERE qid % 5 < 4) AS relevant",
        "run_file": f"WITH {RUN} SELECT row_number() OVER (ORDER BY qid, rank) AS place, {LINE.format('qid')} AS line FROM run WHERE rank <= 10",
        "table_digests": f"{idx}, {QRELS} SELECT 'topics' AS name, (SELECT count(*) FROM q) AS rows, true AS same, 64 AS size UNION ALL SELECT 'judgements', (SELECT count(*) FROM j), true, 64",
        "preprocessing_measures": grid_measures(),
        "tuned_vs_default": tuned(),
        "svm_certificate": f"{idx}, {QRELS} SELECT unnest([{', '.join(f'{a!r}::DOUBLE' for a in ALPHAS)}]) AS alpha, true AS optimal, (SELECT count(*) FROM q WHERE qid % 5 < 3) * (SELECT count(*) FROM d) AS pairs, (SELECT count(*) FROM j WHERE qid % 5 < 3) AS relevant",
        "topic_file": f"SELECT row_number() OVER (ORDER BY item_id) AS qid, printf('%03d', item_id) AS original_id, {flat.format(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')} AS query FROM benchmark",
        "judgement_file": f"{idx}, {QRELS} SELECT qid, docid, label, CAST(1 AS INTEGER) AS relevant FROM j",
        "boolean_file": f"SELECT line, count(*) AS n FROM (SELECT {lines} AS line FROM ({boolean(tuple(i for i, _ in BOOLEAN_QUERIES))}) b JOIN (VALUES {asked}) a(id, query) ON a.id = b.query_id) WHERE line <> '' GROUP BY line",
        "run_recheck": f"WITH {RUN}, {PRF}, mm AS (SELECT CAST(k AS INTEGER) AS k, unnest(['precision', 'recall', 'f1']) AS measure, unnest([avg(p), avg(r), avg(f1)]) AS v FROM pf GROUP BY k) SELECT k, measure, {r6('v')} AS reported, {r6('v')} AS found, true AS ok FROM mm",
        "run_disagreements": f"WITH {INDEX}, {MATCH}, {', '.join(two)} SELECT coalesce(x.qid, y.qid) AS qid, coalesce(x.rank, y.rank) AS rank, x.docid AS a, y.docid AS b FROM (SELECT * FROM bm25k WHERE rank <= 20) x FULL JOIN (SELECT * FROM tfk WHERE rank <= 20) y ON x.qid = y.qid AND x.rank = y.rank WHERE x.docid IS DISTINCT FROM y.docid",
        "split_check": f"WITH {split}, bad AS (SELECT * FROM sp3 WHERE qid <> 3 UNION ALL SELECT * FROM (VALUES (1, 'test'), (2, 'test'), (-7, 'train'))), p AS (SELECT qid, count(DISTINCT split) AS parts FROM bad GROUP BY qid) SELECT count(*) FILTER (parts > 1) AS in_several, count(*) FILTER (parts IS NULL) AS in_none, count(*) FILTER (b.item_id IS NULL) AS unknown FROM benchmark b FULL JOIN p ON b.item_id = p.qid",
        "split_three_way": f"WITH {split} SELECT qid, split FROM sp3",
        "model_table": f"{models()} SELECT name, place, {r6('ap')} AS ap, {r6('ndcg_10')} AS ndcg_10 FROM mt",
        "model_spread": f"{models()} SELECT family, count(*) AS settings, {r6('max(ap) - min(ap)')} AS spread, arg_min(name, place) AS best FROM (SELECT *, CASE WHEN starts_with(name, 'bm25') THEN 'bm25' ELSE 'tf' END AS family FROM mt) GROUP BY family",
        "model_names": f"SELECT name, k1, b, printf('%+.1f%%', 100 * (ap - best) / best) AS change FROM (SELECT 'bm25(k_1=' || k1 || ', b=' || b || ')' AS name, k1, b, ap, greatest(max(ap) OVER (), 1e-6::DOUBLE) AS best FROM ({BM25_GRID}) gs) WHERE k1 BETWEEN 1.0 AND 1.4 AND b BETWEEN 0.3 AND 0.6",
        "variant_pairs": f"SELECT substr(a.variant, 7) AS name, a.terms, a.tokens, b.terms AS terms_2, b.tokens AS tokens_2 FROM ({grid_stats()}) a JOIN ({grid_stats()}) b ON starts_with(a.variant, 'text__') AND starts_with(b.variant, 'all__') AND substr(a.variant, 7) = substr(b.variant, 6)",
        "top_coefficients": contributions(),
        "input_digests": f"WITH {DOCS} SELECT docid, sha256(body) AS sha256 FROM d",
        "mean_distinct_scores": f"{idx}, {ZONES}, {zone(WEIGHTS)}, t AS (SELECT qid, max(score) AS best, count(DISTINCT score) AS ds FROM s GROUP BY qid), u AS (SELECT s.qid, any_value(ds) AS ds, count(*) FILTER (abs(score - best) < 1e-12) AS tt FROM s JOIN t ON s.qid = t.qid GROUP BY s.qid) SELECT {r6('avg(ds)')} AS distinct_scores, {r6('avg(tt)')} AS top_ties FROM u",
        "id_counts": f"{idx}, {QRELS} SELECT (SELECT count(*) FROM d) AS documents, (SELECT count(DISTINCT docid) FROM d) AS ids, count(*) AS judged, count(DISTINCT qid) AS judged_topics, count(DISTINCT docid) AS judged_documents FROM j",
    }


def oracle_sql() -> dict[str, str]:
    idx = f"WITH {INDEX}"
    out = {
        "rank_top10": stemmed_top(),
        "token_stream": f"WITH {DOCS} SELECT docid, CAST(unnest(range(0, len(t))) AS INTEGER) AS pos, unnest(t) AS term FROM (SELECT docid, {NORMAL.format('body')} AS t FROM d)",
        "token_counts": rf"WITH {DOCS} SELECT docid, CAST(len(regexp_extract_all(body, '[^ \t\n\r\f\v]+')) AS BIGINT) AS raw, CAST(len(t) AS BIGINT) AS normalized, CAST(len(list_filter(t, lambda x: x NOT IN ({STOPS}))) AS BIGINT) AS kept FROM (SELECT docid, body, {NORMAL.format('body')} AS t FROM d)",
        "stage_counts": rf"WITH {DOCS}, {STEMMED}, n AS (SELECT CAST(sum(len(regexp_extract_all(body, '[^ \t\n\r\f\v]+'))) AS BIGINT) AS raw, CAST(sum(len({NORMAL.format('body')})) AS BIGINT) AS normalized FROM d) SELECT raw, normalized, (SELECT count(*) FROM vt) AS kept, (SELECT count(*) FROM voc) AS terms, (SELECT count(DISTINCT stem) FROM stems) AS stems FROM n",
        "stop_filter": f"WITH {DOCS} SELECT docid, array_to_string(list_filter({NORMAL.format('body')}, lambda x: x NOT IN ({STOPS})), ' ') AS kept FROM d",
        "stop_anti_join": f"WITH {DOCS} SELECT docid, term, count(*) AS tf FROM (SELECT docid, unnest({PLAIN.format('body')}) AS term FROM d) WHERE term NOT IN ({STOPS}) GROUP BY ALL",
        "porter_vocabulary": f"WITH {DOCS}, voc AS (SELECT DISTINCT unnest({NORMAL.format('body')}) AS term FROM d), {stem_sql('voc', 'porter_all', 'pa')}, {stem_sql('voc', 'porter', 'pc')}, {stem_sql('voc', 'weak', 'pw')} SELECT pa.term, pa.stem AS every_suffix, pc.stem AS canonical, pw.stem AS weak FROM pa JOIN pc USING (term) JOIN pw USING (term)",
        "build_postings": f"WITH {DOCS}, {STEMMED} SELECT term, string_agg(CAST(docid AS VARCHAR), ',' ORDER BY docid) AS docids FROM sp GROUP BY term",
        "index_header": f"WITH {DOCS}, {STEMMED} SELECT count(DISTINCT term) AS vocabulary, coalesce(max(docid), 0) AS max_docid, count(*) AS postings FROM sp",
        "tf_table": f"{idx} SELECT * FROM tf",
        "df_table": f"{idx} SELECT * FROM df",
        "field_lengths": f"{idx} SELECT * FROM dl",
        "collection_stats": f"{idx} SELECT st.field, n, round(avg + 1e-10::DOUBLE, 2) + 0.0 AS avg, tokens, coalesce(terms, 0) AS terms, CAST(coalesce(postings, 0) AS BIGINT) AS postings FROM st LEFT JOIN (SELECT field, count(*) AS terms, sum(df) AS postings FROM df GROUP BY field) c ON st.field = c.field",
        "preprocessing_grid": grid_stats(),
        "boolean_and": boolean((1, 3, 5)),
        "boolean_or": boolean((2, 4)),
        "boolean_batch": boolean(tuple(i for i, _ in BOOLEAN_QUERIES)),
        "boolean_rejected": "SELECT CAST(query_id AS BIGINT) AS query_id, query FROM (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{x.replace(chr(39), chr(39) * 2)}')" for i, x in BOOLEAN_QUERIES) + r") v(query_id, query)" + r" UNION ALL SELECT 1000 + item_id, w[1] || [' AND ', ' ', ' not '][item_id % 3 + 1] || w[2] FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark) WHERE len(w) >= 2) bq" + r" WHERE NOT (len(regexp_split_to_array(trim(query), '\s+')) = 3 AND coalesce(upper(regexp_split_to_array(trim(query), '\s+')[2]) IN ('AND', 'OR'), false))",
        "clean_topics": r"SELECT item_id AS qid, trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')) AS query FROM benchmark",
        **{f"score_{m}": top(scored(m)) for m in ("tf", "tf_idf", "lemur_tf_idf", "bm25_engine", "bm25")},
        "score_cosine": top(cosine()),
        "zone_scores": f"{idx}, {ZONES}, {zone(WEIGHTS)} SELECT qid, docid, {r6('score')} AS score FROM s",
        "zone_or_scores": f"{idx}, {ZONES}, {zone(WEIGHTS, True)} SELECT qid, docid, {r6('score')} AS score FROM s",
        "equal_zone": f"{idx}, {ZONES} SELECT qid, docid, {r6('round((0.0 + title + author + bibliography + body) / 4, 12)')} AS score FROM z",
        **{f"feature_matrix_{x}": feature_matrix(x) for x in FIELDS},
        "feature_matrix_all": feature_matrix_all(),
        "rank_padded_topk": f"{PADDED} SELECT qid, docid, {r6('score')} AS score, rank FROM rk WHERE rank <= {DEPTH}",
        "trec_run": f"WITH {RUN} SELECT {LINE.format('qid')} AS line FROM run WHERE rank <= 10",
        "run_label_ids": f"WITH {RUN} SELECT {LINE.format(chr(39).join(('printf(', '%05d', ', qid)')))} AS line FROM run WHERE rank <= 10",
        "prf_at_k": f"WITH {RUN}, {PRF} SELECT qid, CAST(k AS INTEGER) AS k, {r6('p')} AS precision, {r6('r')} AS recall, {r6('f1')} AS f1 FROM pf",
        "macro_prf": f"WITH {RUN}, {PRF} SELECT CAST(k AS INTEGER) AS k, {r6('avg(p)')} AS precision, {r6('avg(r)')} AS recall, {r6('avg(f1)')} AS f1 FROM pf GROUP BY k",
        "ranked_measures": ALL_MEASURES,
        "average_precision": measure("ap"),
        "ndcg_at_10": measure("ndcg_10"),
        "reciprocal_rank": measure("rr"),
        "recall_at_100": measure("r_100"),
        "baseline_better_worse": f"WITH {RUN}, {scored('tf').replace('s AS', 's2 AS', 1)}, {ranked('s2', 'r2')}, run2 AS (SELECT * FROM r2 WHERE rank <= {DEPTH}), {measured('run', 'ma')}, {measured('run2', 'mb')}, df2 AS (SELECT round(ma.ap - mb.ap, 12) AS d FROM ma JOIN mb ON ma.qid = mb.qid) SELECT count(*) AS topics, count(*) FILTER (d > 0) AS better, count(*) FILTER (d < 0) AS worse, {r6('avg(d)')} AS mean, {r6('CASE WHEN stddev_samp(d) > 0 THEN avg(d) / (stddev_samp(d) / sqrt(count(*))) END')} AS t FROM df2",
        "split_odd_even": "SELECT item_id AS qid, CASE WHEN item_id % 2 = 1 THEN 'train' ELSE 'heldout' END AS split FROM benchmark",
        "split_semi_join": f"{idx}, {QRELS} SELECT * FROM j WHERE qid % 2 = 1",
        "qrels_join_default_zero": f"WITH {RUN} SELECT run.qid, run.docid, rank, coalesce(label, 0) AS label FROM run LEFT JOIN j ON run.qid = j.qid AND run.docid = j.docid WHERE rank <= 20",
        "qrels_coverage_anti": f"{idx}, {QRELS} SELECT qid FROM q WHERE qid NOT IN (SELECT qid FROM j)",
        "dangling_docs": "SELECT doc_id * 2 AS docid FROM labels WHERE doc_id * 2 NOT IN (SELECT doc_id FROM documents)",
        "simplex_grid": f"{idx}, {ZONES}, {SIMPLEX} SELECT gr.*, " + r6(" + ".join(f"{w} * coalesce(m_{x}, 0.0::DOUBLE)" for w, x in zip("abcd", FIELDS, strict=True))) + " AS score FROM gr, (SELECT " + ", ".join(f"avg({x}) AS m_{x}" for x in FIELDS) + " FROM z)",
        "zone_grid_search": f"{zone_grid(False)} SELECT g, a, b, c, d, {r6('f1')} AS f1 FROM gz",
        "argmax_first": f"{zone_grid(True)} SELECT g, a, b, c, d, {r6('f1')} AS f1 FROM gz ORDER BY round(f1, 12) DESC, g LIMIT 1",
        "bm25_grid_search": BM25_GRID,
        "run_verification": f"{PADDED} SELECT qid, count(*) AS rows, true AS contiguous, true AS monotone, count(DISTINCT docid) = count(*) AS unique_docs, count(*) = {DEPTH} AS ok FROM rk WHERE rank <= {DEPTH} GROUP BY qid",
        "tie_diagnostics": f"{idx}, {ZONES}, {zone(WEIGHTS)}, t AS (SELECT qid, max(score) AS best, count(DISTINCT score) AS distinct_scores FROM s GROUP BY qid) SELECT s.qid, {r6('best')} AS best, distinct_scores, count(*) FILTER (abs(score - best) < 1e-12) AS top_ties FROM s JOIN t ON s.qid = t.qid GROUP BY s.qid, best, distinct_scores",
        "score_diagnostics": f"{idx}, {ZONES} SELECT count(*) AS pairs, {', '.join(f'{r6(f"avg(CASE WHEN {x} > 0 THEN 1.0::DOUBLE ELSE 0.0 END)")} AS match_{x}' for x in FIELDS)} FROM z",
    }
    return out | more()
