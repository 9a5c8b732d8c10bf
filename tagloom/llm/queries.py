"""One query per text operator, over its whole table with production parameters."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import bpe, ctw, decontaminate, htmltext, linededup, manifest, packing, quantiser, simhash, toxicity, treapsearch, urlfilter, warc
from tagloom.llm.store import held_out
from tagloom.llm.registry import QUERIES, query, table  # noqa: F401


@query("op1_simhash_near_dedup")
def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document: three-word shingles, links of at most three bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, radius=3)
    return found.select(
        F.col("key").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def byte_vocabulary() -> str:
    """Where the installed public byte-level vocabulary lies; the operators take any other path as well."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoding_digests(documents: DataFrame, vocabulary_path: str) -> DataFrame:
    """Token count and digests of the tokens and of the text decoded from them, per document."""
    coded = bpe.round_trip(documents, vocabulary_path, store_bytes=128_000_000)
    return coded.select(
        F.col("key").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


@query("op8_bpe_round_trip")
def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again, as digests."""
    return encoding_digests(table(spark, sf_dir, "documents"), byte_vocabulary())


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learnt from the labelled ones that are not held out."""
    documents = table(spark, sf_dir, "documents")
    model = toxicity.train(documents, table(spark, sf_dir, "labels"))
    found = toxicity.scored(documents.select("doc_id", "text"), model)
    return found.select(
        "doc_id",
        held_out(F.col("doc_id"), 5, 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


SITE_RULES = (
    urlfilter.site_rule("allow", "org", "/"),
    urlfilter.site_rule("block", "example.org", "/es/"),
    urlfilter.site_rule("block", "example.org", "/en/1"),
    urlfilter.site_rule("allow", "com", "/fr/"),
    urlfilter.site_rule("block", "com", "/de/"),
)
PATTERN_RULES = tuple(urlfilter.pattern_rule("block", p) for p in ("^spam-farm^", "^cheap-pills^", "^casino^", "^xxx^", "/ads/*.js^"))

URL_SQL = r"""
WITH parts AS (SELECT page_id, url,
    coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*[^?#]*((?s:.*))', 1), '') AS rest
  FROM pages),
ruled AS (SELECT *, translate('//' || host || path || rest, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key,
    CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
         WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
         WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
         WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
         WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM parts),
found AS (SELECT *, CASE WHEN rule IS NOT NULL OR (host = '' AND path = '') THEN NULL
         WHEN regexp_matches(key, '[^a-z0-9]cheap-pills([^a-z0-9]|$)') THEN '^cheap-pills^'
         WHEN regexp_matches(key, '[^a-z0-9]spam-farm([^a-z0-9]|$)') THEN '^spam-farm^'
         WHEN regexp_matches(key, '(?s)/ads/.*\.js([^a-z0-9]|$)') THEN '/ads/*.js^'
         WHEN regexp_matches(key, '[^a-z0-9]casino([^a-z0-9]|$)') THEN '^casino^'
         WHEN regexp_matches(key, '[^a-z0-9]xxx([^a-z0-9]|$)') THEN '^xxx^' END AS pattern
  FROM ruled)
SELECT page_id, host, path, rule, pattern, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
  WHEN rule IS NOT NULL OR pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict FROM found"""


@query("op3_url_filters", URL_SQL)
def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    found = urlfilter.judged(table(spark, sf_dir, "pages"), SITE_RULES + PATTERN_RULES)
    return found.select("page_id", "host", "path", "rule", "pattern", "verdict")


@query("op6_html_extraction")
def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = htmltext.extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op10_embedding_near_dedup")
def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector at a cosine of 0.95 or more."""
    found = quantiser.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.95)
    same = F.coalesce(F.col("key") == F.col("component"), F.lit(False))
    return found.select(F.col("key").alias("vec_id"), "n_links", F.col("component").alias("component_id"), same.alias("kept"))


LEAKS_SQL = r"""
WITH i AS (SELECT item_id, w, len(w) AS n, least(5, len(w)) AS k FROM
    (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark) WHERE len(w) > 0),
ish AS (SELECT item_id, n, k, n - k + 1 AS m, array_to_string(w[p + 1 : p + k], ' ') AS s, count(*) AS c
  FROM i, unnest(range(n - k + 1)) AS t(p) GROUP BY ALL),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
dsh AS MATERIALIZED (SELECT r, doc_id, len(w) AS nd, k, p, array_to_string(w[p + 1 : p + k], ' ') AS s
  FROM (SELECT * FROM d, (SELECT DISTINCT k FROM i)), unnest(range(greatest(len(w) - k + 1, 0))) AS t(p)),
mt AS MATERIALIZED (SELECT r, doc_id, nd, item_id, n, m, dsh.k, c, p, s FROM dsh JOIN ish USING (s, k)),
wn AS (SELECT DISTINCT r, doc_id, nd, item_id, n, m, k, greatest(0, least(st, greatest(nd - n, 0))) AS st
  FROM mt, unnest(range(p - m + 1, p + 1)) AS t(st)),
ov AS (SELECT wn.r, wn.doc_id, wn.item_id, wn.st, wn.m, least(wn.n, wn.nd) AS words, least(wn.n, wn.nd) - wn.k + 1 AS mw, mt.s, least(count(*), any_value(mt.c)) AS o
  FROM wn JOIN mt ON wn.r = mt.r AND wn.item_id = mt.item_id AND mt.p BETWEEN wn.st AND wn.st + least(wn.n, wn.nd) - wn.k GROUP BY ALL),
sm AS (SELECT r, doc_id, item_id, st, words, sum(o)::DOUBLE / (any_value(m) + any_value(mw) - sum(o))::DOUBLE AS similarity
  FROM ov GROUP BY r, doc_id, item_id, st, words)
SELECT doc_id, item_id, similarity, st::INT AS start, words::INT AS words FROM sm WHERE similarity >= 0.8
QUALIFY row_number() OVER (PARTITION BY r, item_id ORDER BY similarity DESC, st) = 1"""


@query("op7_benchmark_decontamination", LEAKS_SQL)
def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item it leaks, with the most similar window."""
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.col("item").alias("item_id"), "similarity", "start", "words")


LINES_SQL = r"""
WITH ls AS (SELECT doc_id, t.i - 1 AS line, trim(t.l, ' ') AS l FROM
    (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents), unnest(a) WITH ORDINALITY AS t(l, i)),
lw AS (SELECT *, string_split(l, ' ') AS w FROM ls WHERE l <> ''),
e AS MATERIALIZED (SELECT l, any_value(w) AS w, min((doc_id, line)) AS own FROM lw GROUP BY l),
d AS MATERIALIZED (SELECT * FROM e WHERE len(w) >= 5),
v AS MATERIALIZED (SELECT l, own, p, array_to_string(list_concat(list_slice(w, 1, p), list_slice(w, p + 2, len(w))), ' ') AS v FROM d, unnest(range(len(w))) AS t(p)),
near AS (SELECT a.l, b.own AS o FROM v a JOIN v b ON a.v = b.v AND a.p = b.p AND b.own < a.own
  UNION ALL SELECT a.l, b.own FROM v a JOIN d b ON a.v = b.l AND b.own < a.own
  UNION ALL SELECT a.l, b.own FROM d a JOIN v b ON a.l = b.v AND b.own < a.own),
firsts AS (SELECT l, min(o) AS first FROM (SELECT l, own AS o FROM e UNION ALL SELECT * FROM near) GROUP BY l)
SELECT DISTINCT doc_id, CAST(line AS INT) AS line, first[1] AS first_doc_id, CAST(first[2] AS INT) AS first_line
FROM lw JOIN firsts USING (l) WHERE (doc_id, line) > first"""


@query("op5_line_dedup", LINES_SQL)
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line that an equal or near line precedes, with the place of the earliest such line."""
    gone = linededup.duplicate_lines(table(spark, sf_dir, "documents"))
    return gone.select(F.col("doc").alias("doc_id"), "line", F.col("first_doc").alias("first_doc_id"), "first_line")


@query("op9_lm_scoring")
def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document under the context-tree model and under word counts."""
    found = ctw.scored(table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("key", "doc_id").withColumn("bits_per_byte", F.col("score") / (F.col("n_bytes") + 1) * float(-1 / math.log10(2)))


def damage() -> dict[str, Column]:
    """Bit rot: by its hash one record in 64 has its first byte changed, is overwritten or is lost; ``damaged`` is the new hash."""
    fate, record = F.substring("hash", 9, 2), F.col("record")
    changed = F.when(fate == "00", F.sha2(F.concat(F.lit("X"), F.expr("substring(record, 2)")), 256))
    return {"fate": fate, "damaged": changed.when(fate == "01", F.sha2(F.repeat(F.lit("#"), F.octet_length(record)), 256))}


FIXITY_SQL = r"""
WITH p AS (SELECT DISTINCT coalesce(CAST(page_id AS VARCHAR), '') AS k, coalesce(url, '') AS u, coalesce(html, '') AS p FROM pages),
r AS (SELECT 'WARC/1.0' || e || 'WARC-Type: response' || e || 'WARC-Record-ID: <urn:page:' || k || '>' || e || 'WARC-Target-URI: ' || u || e
    || 'WARC-Date: 2024-01-01T00:00:00Z' || e || 'Content-Type: text/html' || e || 'Content-Length: ' || strlen(p) || e || e || p || e || e AS record
  FROM p, (SELECT chr(13) || chr(10) AS e)),
h AS (SELECT record, sha256(record) AS h, greatest(1, ceil((SELECT count(*) FROM r) / 1000.0))::BIGINT AS files FROM r),
f AS (SELECT record, h, 'crawl-' || lpad(CAST(CAST('0x' || h[1:8] AS BIGINT) % files AS VARCHAR), 8, '0') || '.warc' AS file FROM h),
o AS (SELECT file, h AS expected, record, strlen(record) AS length, coalesce(sum(strlen(record)) OVER (PARTITION BY file ORDER BY h
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset", h[9:10] AS fate FROM f)
SELECT file, "offset", length, CASE WHEN fate IN ('02', '03') THEN 'missing' ELSE 'changed' END AS kind, expected,
  CASE fate WHEN '00' THEN sha256('X' || substr(record, 2)) WHEN '01' THEN sha256(repeat('#', length)) END AS found
FROM o WHERE fate IN ('00', '01', '02', '03')"""


@query("op2_warc_fixity_audit", FIXITY_SQL)
def op2_warc_fixity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every damaged record of a replica of the archive of all pages."""
    archive = warc.catalogued(table(spark, sf_dir, "pages"), kept=damage())
    replica = archive.where("fate not in ('02', '03')").select("file", "offset", "length", F.coalesce("damaged", "hash").alias("hash"))
    return warc.compared(archive.drop("fate", "damaged"), replica)


MANIFEST_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_FIELDS = "concat(" + ", ".join("coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')".format(c) for c in MANIFEST_COLUMNS) + ")"
MANIFEST_SQL = f"""
WITH RECURSIVE d AS (SELECT *, list_reduce(list_prepend(4294967295, [CAST(ord(x) AS BIGINT) FOR x IN string_split(CAST(doc_id AS VARCHAR), '')]),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, CAST(3988292384 AS BIGINT) * (x & 1)))) AS c FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM (
  SELECT doc_id, coalesce('=' || lang, '') AS grp, sha256({_FIELDS}) AS leaf, changed FROM (
    SELECT *, (SELECT sha256({_FIELDS}) FROM (SELECT d.doc_id, d.source, d.lang, CASE WHEN xor(d.c, 4294967295) % 7 = 0 THEN d.n_chars + 1 ELSE d.n_chars END AS n_chars, d.text)) AS changed FROM d))),
levels AS (SELECT grp, 0 AS lv, list(leaf ORDER BY pos) AS ns FROM l GROUP BY grp
  UNION ALL SELECT grp, lv + 1, list_transform(range(0, len(ns), 2), lambda i: sha256(ns[i + 1] || coalesce(ns[i + 2], ''))) FROM levels WHERE len(ns) > 1),
subs AS (SELECT grp, ns[1] AS subroot, row_number() OVER (ORDER BY grp) - 1 AS pos FROM levels WHERE len(ns) = 1),
tops AS (SELECT 1000 AS lv, list(subroot ORDER BY pos) AS ns FROM subs
  UNION ALL SELECT lv + 1, list_transform(range(0, len(ns), 2), lambda i: sha256(ns[i + 1] || coalesce(ns[i + 2], ''))) FROM tops WHERE len(ns) > 1),
steps AS (SELECT l.grp, l.pos, lv, ns, l.pos >> lv AS p FROM l JOIN levels USING (grp) WHERE len(ns) > 1
  UNION ALL SELECT l.grp, l.pos, lv, ns, subs.pos >> (lv - 1000) FROM l JOIN subs USING (grp), tops WHERE len(ns) > 1),
proof AS (SELECT grp, pos, list(CASE WHEN p % 2 = 1 THEN ns[p] || '|' ELSE '|' || coalesce(ns[p + 2], '') END ORDER BY lv) AS s FROM steps GROUP BY grp, pos),
r AS (SELECT l.*, subroot, (SELECT ns[1] FROM tops WHERE len(ns) = 1) AS root, coalesce(s, []) AS s FROM l JOIN subs USING (grp) LEFT JOIN proof ON l.grp = proof.grp AND l.pos = proof.pos)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(s, ''), '|', '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM (
  SELECT *, list_reduce(list_prepend(changed, s), lambda a, x: sha256(split_part(x, '|', 1) || a || split_part(x, '|', 2))) AS folded_root FROM r)"""


@query("op11_merkle_manifest", MANIFEST_SQL)
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of all documents by language; each row's proof, and the root it leads to after tampering with a seventh of them."""
    documents = table(spark, sf_dir, "documents")
    tampered = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 7 == 0, F.lit(False))
    values = [F.col(c) if c != "n_chars" else F.when(tampered, F.col(c) + 1).otherwise(F.col(c)) for c in MANIFEST_COLUMNS]
    rows = manifest.built(documents, MANIFEST_COLUMNS, "lang", "doc_id", {"changed": manifest.leaf(values)}).proofs()
    proof, root = F.col("proof"), manifest.folded(F.col("changed"), F.col("proof"))
    digests = rows.select(F.col("key").alias("doc_id"), F.col("hash").alias("leaf"), "subroot", "root", F.sha2(manifest.proof_text(proof), 256).alias("proof_sha256"), root.alias("folded_root"))
    return digests.withColumn("verified", F.col("folded_root") == F.col("root"))


SEARCH_SQL = r"""
WITH t AS (SELECT r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT *, row_number() OVER () AS r FROM documents)),
tf AS MATERIALIZED (SELECT r, doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
len AS MATERIALIZED (SELECT r, sum(tf)::BIGINT AS n FROM tf GROUP BY r),
st AS (SELECT count(*) AS docs, sum(n)::BIGINT AS l FROM len),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), st),
s AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * docs) // l)))))::BIGINT AS score
  FROM i JOIN w USING (term) JOIN tf USING (term) JOIN len USING (r), st GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY rank <= 10"""


@query("op13_ranked_search", SEARCH_SQL)
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all documents for every benchmark item."""
    found = treapsearch.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)
    return found.select(F.col("item").alias("item_id"), "rank", F.col("key").alias("doc_id"), "score")


@query("op12_packing")
def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in sequences of at most 4096 tokens."""
    import public_tokenizers

    found = packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end=2, with_ids=False)
    return found.withColumnRenamed("key", "doc_id")
