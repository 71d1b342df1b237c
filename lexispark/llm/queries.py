"""Queries over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm import conversations, decontam, dedup, licenses, mixing, ngramjoin, packing, pii, sharding, spelling, toxicity, urlfilter, warc
from lexispark.llm.common import folder, table

AZ = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = "regexp_extract_all({0}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_dedup(table(spark, sf_dir, "documents"))


OP1 = f"""
WITH d AS (SELECT doc_id, {AZ.format("text")} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       coalesce(doc_id = max(doc_id) OVER (PARTITION BY t), false) AS kept, sha256(t) AS text_sha256
FROM d"""


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items", "spans")


OP2 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS.format(AZ.format("text"))} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {WORDS.format(AZ.format("text"))} AS w FROM benchmark),
bl AS (SELECT item, w, least(len(w), 13) AS n FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bl)),
dw AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bl) WHERE len(w) >= n)),
hit AS (SELECT r, i, dw.n, item FROM dw JOIN win ON dw.n = win.n AND dw.g = win.g),
cov AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cov USING (r) LEFT JOIN its USING (r)"""


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def _op3() -> str:
    """The same canonical form in SQL; digests of the known texts are computed there too."""
    text = lambda t: "'" + t.replace("'", "''") + "'"
    lines = lambda c: f"regexp_replace(regexp_replace(chr(10) || {AZ.format(c)}, {text(licenses.COPYRIGHT)}, chr(10), 'g'), {text(licenses.PUNCTUATION)}, ' ', 'g')"

    def spelled(c: str) -> str:
        """Word by word first, then variants of several words, between blanks that neighbours do not share."""
        cases = " ".join(f"WHEN {text(a)} THEN {text(b)}" for a, b in licenses.SPELLINGS if " " not in a)
        out = f"array_to_string(list_transform(string_split({c}, ' '), lambda w: ' ' || CASE w {cases} ELSE w END || ' '), '')"
        for a, b in licenses.SPELLINGS:
            if " " in a:
                out = f"replace({out}, {text(' ' + a.replace(' ', '  ') + ' ')}, {text(' ' + b.replace(' ', '  ') + ' ')})"
        return f"trim(replace({out}, '  ', ' '), ' ')"

    unit = lambda c: spelled(f"trim(regexp_replace({c}, '[ \\n]+', ' ', 'g'), ' ')")
    known = ", ".join(f"({text(i)}, {text(k)}, {text(t)})" for i, k, t in licenses.KNOWN)
    return f"""
WITH k AS (SELECT digest, any_value(id) AS id, any_value(kind) AS kind FROM
  (SELECT sha256({unit("c")}) AS digest, id, kind FROM (SELECT id, kind, {lines("t")} AS c FROM (VALUES {known}) v(id, kind, t))) GROUP BY digest),
d AS (SELECT row_number() OVER () AS r, doc_id, {lines("text")} AS c FROM documents),
u AS (SELECT r, 'whole' AS what, c AS x FROM d UNION ALL
      SELECT r, 'paragraph', unnest(string_split(regexp_replace(c, '\\n ?\\n[ \\n]*', chr(11), 'g'), chr(11))) FROM d UNION ALL
      SELECT r, 'line', unnest(string_split(c, chr(10))) FROM d),
f AS (SELECT r, what, id, kind FROM u JOIN k ON sha256({unit("x")}) = digest),
g AS (SELECT r, max(CASE WHEN what = 'whole' THEN id END) AS whole_license, string_agg(DISTINCT id, ',' ORDER BY id) AS licenses,
      count(*) FILTER (what = 'line') AS n_notices, bool_or(kind <> 'permissive') AS restricted FROM f GROUP BY r)
SELECT doc_id, whole_license, coalesce(licenses, '') AS licenses, coalesce(n_notices, 0) AS n_notices, coalesce(restricted, false) AS restricted
FROM d LEFT JOIN g USING (r)"""


#: Small enough that the test tables have several shards and files roll; the operator's defaults are 256 MB and 1 GB.
ROLL_BYTES, SHARD_PAYLOAD = 64 << 10, 512 << 10


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = folder(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), archive, roll_bytes=ROLL_BYTES, shard_bytes=SHARD_PAYLOAD)
    return warc.read_warc(spark, archive, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4 = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, payload_bytes < 100 OR row_number() OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST) = 1 AS own,
             min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN own THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN NOT own THEN first END AS refers_to FROM f"""

#: A fixed key, so that reruns of the query agree; real use passes a secret.
PII_KEY = b"query key"


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(table(spark, sf_dir, "documents"), PII_KEY)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source", "copies")


OP6 = r"""
WITH d AS (SELECT doc_id, source IS NULL AS absent, coalesce(source, '') AS source,
                  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS mark FROM documents),
c AS (SELECT *, length(bin(size)) * 16 + (size >> greatest(length(bin(size)) - 4, 0)) AS class, mark % 64 AS part FROM d),
s AS (SELECT absent, source, sum(size) AS source_size FROM d GROUP BY ALL),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY absent, source) - 1) % 3 AS weight, row_number() OVER (ORDER BY absent, source) AS place FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY 3 * source_size / weight, place) AS turn, sum(source_size) OVER () AS total,
             coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
             sum(weight) OVER (ORDER BY 3 * source_size / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w),
l AS (SELECT turn AS first, total - before AS remaining, rest AS among FROM o WHERE (total - before) * weight <= 3 * source_size * rest ORDER BY turn LIMIT 1),
t AS (SELECT absent, source, source_size,
             CASE WHEN turn >= first THEN CAST(remaining * weight AS DOUBLE) / CAST(among AS DOUBLE) ELSE CAST(3 * source_size AS DOUBLE) END AS target FROM o LEFT JOIN l ON true),
e AS (SELECT *, CASE WHEN source_size > 0 THEN target / CAST(source_size AS DOUBLE) ELSE 0 END AS each,
             (CAST('0x' || substr(md5('7:' || CASE WHEN absent THEN '-' ELSE '+' END || source), 1, 4) AS BIGINT) + 0.5::DOUBLE) / 65536::DOUBLE AS start FROM t),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY c.absent, c.source ORDER BY class, part, size, mark) AS DOUBLE) AS rank FROM c)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(floor(rank * each + start) - floor((rank - 1) * each + start) AS BIGINT) * size AS taken
FROM r JOIN e ON r.absent = e.absent AND r.source = e.source"""

RULES = ("block com/en/", "allow example.com/en/7", "allow net/de/", "block example.net/de/8", "block org/es/")


#: The test tables have no labelled urls, so the pages' own texts give the labels; a template is rejected if a page of it is more likely junk than not.
PURITY, SMOOTHING = 0.5, 2.0


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urlfilter.url_filter(pages, urlfilter.parse_rules(RULES), urlfilter.junk_labels(pages), purity=PURITY, smoothing=SMOOTHING)


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.ngram_join(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Small enough that the test tables split; the operator's default is 32 MB.
SHARD_BYTES = 256 << 10


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"), limit=SHARD_BYTES).drop("text")


OP10 = f"""
WITH RECURSIVE k AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS bytes,
     CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS h FROM documents),
lv AS (SELECT depth, h >> (60 - depth) AS p, sum(bytes) AS b, count(*) AS n, min(h) = max(h) AS one FROM k, (SELECT unnest(range(0, 61)) AS depth) GROUP BY ALL),
fit AS (SELECT *, b <= {SHARD_BYTES} OR one OR depth = 60 AS fits FROM lv),
leaf AS (SELECT f.depth, f.p, f.b, f.n FROM fit f LEFT JOIN fit u ON u.depth = f.depth - 1 AND u.p = f.p >> 1 WHERE f.fits AND NOT coalesce(u.fits, false))
SELECT doc_id, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(p), CAST(depth AS INTEGER), '0') END AS shard, CAST(depth AS INTEGER) AS depth,
       CAST(b AS BIGINT) AS shard_bytes, n AS shard_docs, bytes
FROM k JOIN leaf ON k.h >> (60 - depth) = leaf.p"""


#: An occurrence loses a code point if this divides the crc32 of its place and letters.
DAMAGE = 97


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), damage=DAMAGE)


#: crc32 by bytes and its table, which are a list each; characters up to U+07FF have one byte or two.
CRC_TABLE = """SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS crc_table"""
BYTES = "flatten(list_transform(string_split({0}, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)] END))"
CRC = f"xor(list_reduce({BYTES}, lambda c, b: xor(c >> 8, crc_table[CAST(xor(c & 255, b) AS BIGINT) + 1]), 4294967295), 4294967295)"

OP11 = f"""
WITH RECURSIVE tab AS ({CRC_TABLE}),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all({AZ.format("text")}, '[a-zÀ-ÿ]+')) AS run FROM documents),
c AS (SELECT id, run, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY ALL),
h AS (SELECT run, n, CAST({CRC.format("id || ':' || run")} AS BIGINT) AS h FROM c, tab),
d AS (SELECT n, CASE WHEN h % {DAMAGE} = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM d WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
gap AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
one AS (SELECT a.word, b.word AS near, b.n AS m FROM gap a JOIN gap b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
        UNION SELECT g.word, v.word, v.n FROM gap g JOIN v ON g.rest = v.word UNION SELECT v.word, g.word, g.n FROM gap g JOIN v ON g.rest = v.word),
b AS (SELECT word, count(*) AS n_near, arg_min(near, (-m, near)) AS near, max(m) AS m FROM one GROUP BY word),
f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN near END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n FROM v LEFT JOIN b USING (word)),
walk AS (SELECT word, word AS at FROM f UNION ALL SELECT w.word, f.form FROM walk w JOIN f ON f.word = w.at WHERE f.form IS NOT NULL),
ends AS (SELECT w.word, w.at AS root FROM walk w JOIN f ON f.word = w.at WHERE f.form IS NULL)
SELECT word, n, n_near, form, form_n, root FROM f JOIN ends USING (word)"""

#: The vocabulary that documents are packed with.
VOCABULARY = "word_bpe_49k.json"


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path(VOCABULARY)
    pieces = packing.pack(table(spark, sf_dir, "documents"), lambda: packing.worker_encoder(path))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversations.repair(conversations.damage(rows), rows)


#: One recursion over all conversations, row by row; equal rows of a turn are not gathered and segments not used.
OP13 = f"""
WITH RECURSIVE tab AS ({CRC_TABLE}),
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               CAST({CRC.format("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} AS BIGINT) % 20 AS h FROM conversations, tab),
rows AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
         FROM (SELECT *, unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) AS copy FROM raw WHERE h <> 0)),
p AS (SELECT *, row_number() OVER w - 1 AS i, substr(role, 1, 1) AS x, lag(substr(role, 1, 1)) OVER w AS before,
             rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS core
      FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text))),
q AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen FROM p),
r AS (SELECT *, core = '' AS blank, core <> '' AND seen AS dup, core <> '' AND NOT seen AND right(core, 1) NOT IN ('.', '!', '?') AS cut FROM q),
n AS (SELECT conv_id, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (cut) AS truncated,
             count(*) FILTER (i > 0 AND before || x NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id),
ins(s, via, k) AS (VALUES (0, 0, 0), (0, 2, 1), (0, 3, 2), (1, 1, 0), (1, 2, 1), (1, 3, 2), (2, 2, 0), (2, 3, 1), (2, 2, 2), (3, 3, 0), (3, 2, 1), (3, 3, 2)),
mv(x, via, e, cost, letter) AS (VALUES ('s', 0, 1, 0, 'K'), ('u', 0, 2, 0, 'K'), ('u', 1, 2, 0, 'K'), ('u', 3, 2, 0, 'K'), ('a', 2, 3, 0, 'K'), (NULL, 0, 2, 1, 'R'), (NULL, 1, 2, 1, 'R'), (NULL, 3, 2, 1, 'R'), (NULL, 2, 3, 1, 'R')),
step AS (SELECT conv_id, i, s, s AS e, 2 AS cost, 'D' AS letters, '' AS said FROM r, (SELECT unnest(range(4)) AS s)
         UNION ALL
         SELECT conv_id, i, s, e, mv.cost + 5 * k + CASE WHEN cut THEN 5 ELSE 0 END, repeat('I', k) || letter,
                CASE k WHEN 0 THEN '' WHEN 1 THEN CASE WHEN s = 2 THEN 'assistant:' ELSE 'user:' END || chr(10) ELSE CASE WHEN s = 2 THEN 'assistant:' || chr(10) || 'user:' ELSE 'user:' || chr(10) || 'assistant:' END || chr(10) END
                || CASE WHEN letter = 'K' THEN role WHEN e = 3 THEN 'assistant' ELSE 'user' END || ':' || text || chr(10)
         FROM r JOIN mv ON mv.x IS NULL OR mv.x = r.x JOIN ins USING (via) WHERE NOT blank AND NOT dup),
walk AS (SELECT conv_id, 0::BIGINT AS i, 0::BIGINT AS s, 0::BIGINT AS cost, '' AS audit, '' AS said FROM n
         UNION ALL
         SELECT conv_id, i + 1, e, best.cost, best.audit, best.said FROM (
           SELECT w.conv_id, w.i, x.e, min({{'cost': w.cost + x.cost, 'audit': w.audit || x.letters, 'said': w.said || x.said}}) AS best
           FROM walk w JOIN step x ON x.conv_id IS NOT DISTINCT FROM w.conv_id AND x.i = w.i AND x.s = w.s GROUP BY ALL)),
done AS (SELECT w.conv_id, min({{'cost': cost + CASE s WHEN 1 THEN 10 WHEN 2 THEN 5 ELSE 0 END, 'audit': audit || CASE s WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END,
                                'said': said || CASE s WHEN 1 THEN 'user:' || chr(10) || 'assistant:' || chr(10) WHEN 2 THEN 'assistant:' || chr(10) ELSE '' END}}) AS best
         FROM walk w JOIN n ON n.conv_id IS NOT DISTINCT FROM w.conv_id AND n.rows = w.i GROUP BY w.conv_id),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit, sha256(regexp_replace(coalesce(best.said, ''), chr(10) || '$', '')) AS repaired_sha256
FROM ids LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM ids.conv_id"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    run = (op1_exact_dedup, op2_decontamination, op3_license_scan, op4_warc, op5_pii, op6_mixing, op7_url_filter, op8_ngram_join, op9_toxicity, op10_sharding, op11_spelling, op12_packing, op13_conversations, pipeline)
    return {f.__name__: f for f in run}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1, "op2_decontamination": OP2, "op3_license_scan": _op3(), "op4_warc": OP4, "op6_mixing": OP6, "op10_sharding": OP10, "op11_spelling": OP11, "op13_conversations": OP13}
