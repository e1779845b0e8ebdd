"""Registered queries of the corpus operators and, where SQL can express them, their DuckDB SQL.

Each query is ``fn(spark, sf_dir) -> DataFrame`` over whole tables; the operators keep their own,
wider results, from which the queries derive their columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, langid, lines, lmscore, periods, pii, resample, shards, simhash, substring, topk, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(key: str, n: int):
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(n))


def vocabulary() -> str:
    """The public vocabulary file of operator 8, where it is installed."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@register("op1_toxicity")
def op1_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 4) != 2)
    return (toxicity.score(docs, model)
            .select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", "predicted"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
e AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM e),
c AS (SELECT DISTINCT doc_id, i + j AS p FROM (SELECT doc_id, i, unnest(range(20)) AS j FROM f WHERE r > 1)),
w AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.p) AS kept, count(*) AS n FROM w ANTI JOIN c ON w.doc_id = c.doc_id AND w.p = c.p GROUP BY w.doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""


@register("op2_substring_dedup", OP2_SQL)
def op2_substring_dedup(spark, sf_dir):
    out = substring.remove_repeats(table(spark, sf_dir, "documents"), window=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@register("op3_simhash")
def op3_simhash(spark, sf_dir):
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), max_bits=4, shingle_words=4)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@register("op4_pii")
def op4_pii(spark, sf_dir):
    """n_<kind> count the base spans; n_found those that context added; spans holds both."""
    out = pii.extract(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *[pii.count_of(F.col("base"), k).alias(f"n_{k}") for k in pii.KINDS],
                      F.sha2(pii.as_text(F.col("base")), 256).alias("base_sha256"),
                      pii.as_text(F.sort_array(F.concat("base", "found"))).alias("spans"), F.size("found").cast("long").alias("n_found"))


@register("op5_decontaminate")
def op5_decontaminate(spark, sf_dir):
    found = decontaminate.find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
                        decontaminate.contaminated().alias("contaminated"))


#: what stands between lines of a page: scripts, styles, comments and tags
MARKUP = r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->|<[^>]*>"
HOST = r"^[a-z][a-z0-9+.-]*://([^/:?#]*)"

OP6_SQL = rf"""
WITH p AS (
  SELECT page_id, regexp_extract(lower(url), '{HOST}', 1) AS host,
         regexp_replace(html, '{MARKUP}', chr(10), 'g') AS text
  FROM pages),
l AS (
  SELECT page_id, host, i, trim(s, chr(32) || chr(9) || chr(13)) AS line, s
  FROM (SELECT page_id, host, unnest(string_split(text, chr(10))) AS s,
               unnest(range(len(string_split(text, chr(10))))) AS i FROM p)),
n AS (SELECT host, count(*) AS all_pages FROM p GROUP BY host),
f AS (SELECT l.host, line, count(DISTINCT page_id) AS pages FROM l WHERE line <> '' GROUP BY l.host, line),
d AS (SELECT f.host, f.line FROM f JOIN n ON f.host IS NOT DISTINCT FROM n.host
      WHERE f.pages >= {lines.MIN_PAGES} AND f.pages > n.all_pages * {lines.RATIO}::DOUBLE),
m AS (SELECT l.*, d.line IS NOT NULL AS gone FROM l LEFT JOIN d ON l.line = d.line AND l.host IS NOT DISTINCT FROM d.host)
SELECT p.page_id, p.host, any_value(p.text IS NOT NULL) AS has_text,
       count(*) FILTER (WHERE m.line <> '') AS n_lines,
       count(*) FILTER (WHERE m.gone) AS n_dropped,
       sha256(coalesce(string_agg(m.line, chr(10) ORDER BY m.i) FILTER (WHERE m.line <> '' AND NOT m.gone), '')) AS kept_sha256
FROM p LEFT JOIN m ON p.page_id = m.page_id
GROUP BY p.page_id, p.host
"""


def page_lines(pages: DataFrame) -> DataFrame:
    """[page_id, host, text] of raw pages: markup becomes line ends."""
    return pages.select("page_id", F.regexp_extract(F.lower("url"), HOST, 1).alias("host"),
                        F.regexp_replace("html", MARKUP, "\n").alias("text"))


@register("op6_line_dedup", OP6_SQL)
def op6_line_dedup(spark, sf_dir):
    kept = lines.drop_boilerplate(page_lines(table(spark, sf_dir, "pages")))
    content = F.filter(F.transform(lines.lines_of(F.coalesce("text", F.lit(""))), lines.bare), lambda s: s != "")
    return kept.select("page_id", "host", F.col("text").isNotNull().alias("has_text"), "n_lines", "n_dropped",
                       F.sha2(F.array_join(content, "\n"), 256).alias("kept_sha256"))


@register("op7_langid")
def op7_langid(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, remainder("doc_id", 3) != 1)
    return (langid.predict(docs.select("doc_id", "text"), model)
            .select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score"))


@register("op8_bpe")
def op8_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, vocabulary(), with_ids=False).drop("text")


OP9_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


@register("op9_topk", OP9_SQL)
def op9_topk(spark, sf_dir):
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


OP10_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS p FROM d),
b AS (SELECT doc_id, w, p, lag(w) OVER (PARTITION BY doc_id ORDER BY p) AS h FROM t),
u AS (SELECT w, count(*) AS n FROM t GROUP BY w),
ud AS (SELECT doc_id, w, count(*) AS n FROM t GROUP BY doc_id, w),
g AS (SELECT h, w, count(*) AS n FROM b WHERE h IS NOT NULL GROUP BY h, w),
gd AS (SELECT doc_id, h, w, count(*) AS n FROM b WHERE h IS NOT NULL GROUP BY doc_id, h, w),
z AS (SELECT doc_id, len(w) AS n, (SELECT count(*) FROM t) - len(w) AS rest FROM d),
s AS (SELECT b.doc_id, coalesce(g.n - gd.n, 0) AS pair, b.h IS NOT NULL AS inner_word, u.n - ud.n AS one, uh.n - udh.n AS context, z.rest
      FROM b JOIN z ON b.doc_id = z.doc_id JOIN u ON b.w = u.w JOIN ud ON b.doc_id = ud.doc_id AND b.w = ud.w
      LEFT JOIN g ON b.h = g.h AND b.w = g.w LEFT JOIN gd ON b.doc_id = gd.doc_id AND b.h = gd.h AND b.w = gd.w
      LEFT JOIN u uh ON b.h = uh.w LEFT JOIN ud udh ON b.doc_id = udh.doc_id AND b.h = udh.w),
x AS (SELECT doc_id, count(*) FILTER (WHERE one > 0 AND pair = 0) AS n1, count(*) FILTER (WHERE pair > 0) AS n2, count(*) FILTER (WHERE one = 0) AS n0,
             sum(CASE WHEN pair > 0 THEN ln(pair / context::DOUBLE)
                      ELSE (CASE WHEN inner_word THEN ln(0.4) ELSE 0 END) + (CASE WHEN one > 0 THEN ln(one / rest::DOUBLE) ELSE ln(0.4) - ln(rest + 1.0) END) END) AS lp
      FROM s GROUP BY doc_id)
SELECT z.doc_id, z.n::BIGINT AS n_words, coalesce(n1, 0)::BIGINT AS n_order1, coalesce(n2, 0)::BIGINT AS n_order2, coalesce(n0, 0)::BIGINT AS n_unseen,
       round(coalesce(lp, 0), 4) AS logprob, round(lp / z.n, 6) AS score
FROM z LEFT JOIN x ON z.doc_id = x.doc_id
"""


@register("op10_lm_score", OP10_SQL)
def op10_lm_score(spark, sf_dir):
    out = lmscore.score(table(spark, sf_dir, "documents"), order=2)
    return out.withColumn("logprob", F.round("logprob", 4)).withColumn("score", F.round("score", 6))


#: crc32 of a list of bytes in SQL: a table of 256 remainders by its rule, then one step a byte
CRC_TABLE = """
crc AS (SELECT list(c ORDER BY i) AS tab FROM (
  SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
  FROM (SELECT unnest(range(256)) AS i)))"""


def crc_sql(text: str) -> str:
    """crc32 of a text column, beside the table's one row."""
    codes = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)"
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), "
            f"lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)")


OP11_SQL = rf"""
WITH {CRC_TABLE.strip()},
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
dw AS (SELECT doc_id, unnest(w) AS w FROM d),
qw AS (SELECT unnest(w) AS w FROM q),
b AS (SELECT w, {crc_sql("w")} % 10000 AS bucket FROM (SELECT DISTINCT w FROM (SELECT w FROM dw UNION ALL SELECT w FROM qw)), crc),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN b USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM qw JOIN b USING (w) GROUP BY bucket),
n AS (SELECT (SELECT count(*) FROM dw) AS all_s, (SELECT count(*) FROM qw) AS all_t),
g AS (SELECT s.bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * (all_s + 10000)::DOUBLE) / ((s.s + 1)::DOUBLE * (all_t + 10000)::DOUBLE)))::BIGINT AS gain
      FROM s LEFT JOIN t ON s.bucket = t.bucket, n),
x AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM dw JOIN b USING (w) JOIN g USING (bucket) GROUP BY doc_id),
y AS (SELECT d.doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
             ('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT AS h FROM d LEFT JOIN x ON d.doc_id = x.doc_id),
z AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM y),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM z WHERE n_features >= 20)
SELECT z.*, CASE WHEN rank <= floor(10 * n / 100) THEN rank END AS rank FROM z LEFT JOIN r ON z.doc_id = r.doc_id
"""


@register("op11_resample", OP11_SQL)
def op11_resample(spark, sf_dir):
    out = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


SHARDS = 40

OP12_SQL = rf"""
WITH RECURSIVE {CRC_TABLE.strip()},
d AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS size, {crc_sql("coalesce(text, '')")} AS text_crc32 FROM documents, crc),
o AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS n FROM d),
c AS (SELECT total, a, greatest(1, ((total + a - 1) // a))::BIGINT AS b FROM (
  SELECT total, greatest(1, ceil(sqrt(total)))::BIGINT AS a FROM (SELECT count(*)::BIGINT AS total FROM d))),
f AS (
  SELECT n, n // b AS l, n % b AS r, 0 AS turn FROM o, c
  UNION ALL
  SELECT n, CASE WHEN turn = {shards.ROUNDS} THEN l ELSE r END,
         CASE WHEN turn = {shards.ROUNDS} THEN r ELSE (l + ('0x' || substr(md5('{shards.SEED}:' || turn || ':' || r), 1, 15))::BIGINT
              % (CASE WHEN turn % 2 = 0 THEN a ELSE b END)) % (CASE WHEN turn % 2 = 0 THEN a ELSE b END) END,
         CASE WHEN turn = {shards.ROUNDS} THEN 0 ELSE turn + 1 END
  FROM f, c WHERE turn < {shards.ROUNDS} OR l * b + r >= total),
p AS (SELECT n, l * b + r AS p FROM f, c WHERE turn = {shards.ROUNDS} AND l * b + r < total)
SELECT doc_id, size + 16 AS size, text_crc32, 'rows' AS law, (p % {SHARDS})::INTEGER AS shard, (p // {SHARDS})::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM o JOIN p ON o.n = p.n
"""


@register("op12_shards", OP12_SQL)
def op12_shards(spark, sf_dir):
    """The law is `rows`: the permuted row number decides, so that counts differ by one at most."""
    docs = table(spark, sf_dir, "documents")
    narrow = docs.select("doc_id", shards.text_bytes(docs["text"]).alias("bytes"), shards.text_crc32(docs["text"]).alias("text_crc32"))
    out = shards.assign(narrow, SHARDS, order=(narrow["text_crc32"], narrow["bytes"]))
    return out.select("doc_id", (F.col("bytes") + 16).alias("size"), "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def made_periodic(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Some texts as the contract alters them: where crc32(key) % 10 = 0, words from one on repeat the words after it."""
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    staged = docs.withColumn("_words", F.when(h % 10 == 0, F.filter(F.split(text_col, r"[\x20\x09-\x0D]+"), lambda w: w != "")))
    staged = staged.withColumn("_n", F.size("_words")).withColumn("_g", F.floor(h / 10).cast("long"))
    staged = staged.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")))
    staged = staged.withColumn("_p", 1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8)).cast("long"))
    word = lambda i: F.get("_words", F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int"))
    changed = F.array_join(F.transform(F.sequence(F.lit(0), F.col("_n") - 1), word), " ")
    return staged.withColumn(text_col, F.when(F.col("_a").isNotNull(), changed).otherwise(F.col(text_col))).drop("_words", "_n", "_g", "_a", "_p")


@register("op13_periodic_runs")
def op13_periodic_runs(spark, sf_dir):
    out = periods.detect(made_periodic(table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = F.element_at(F.sort_array(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))), 1)
    out = out.withColumn("_best", F.when(F.size("runs") > 0, best))
    length = -F.col("_best.l")
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_best.s").alias("start"), length.alias("length"),
                      F.col("_best.p").alias("period"), F.floor(1000 * length / F.col("_best.p")).cast("long").alias("exponent_milli"),
                      F.sha2(periods.as_lines("runs"), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
