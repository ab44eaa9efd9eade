"""One query per operator with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from layerlab.llm import (
    decontaminate,
    exact_dedup,
    hadamard_kmeans,
    importance,
    line_dedup,
    order_minhash,
    prefix_bpe,
    relative_lz,
    repeats,
    reply_trees,
    secret_scan,
    simhash,
    toxicity,
)
from layerlab.llm.common import sha

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

MIN_LINE_DOCS = 10
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "op1_exact_dedup",
    r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h
  FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, h AS text_sha256
FROM t WINDOW w AS (PARTITION BY h)
""",
)
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))
    digest = F.lower(F.hex("digest")).alias("text_sha256")
    return groups.select("doc_id", "keep_id", "group_size", "kept", digest)


@query(
    "op10_line_dedup",
    r"""
WITH l AS (
  SELECT doc_id, coalesce(text, '') AS text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
""",
)
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.line_dedup(table(spark, sf_dir, "documents"), MIN_LINE_DOCS)
    return kept.select("doc_id", "n_lines", "n_dropped", sha(F.col("text")).alias("kept_sha256"))


@query("op3_prefix_bpe")
def op3_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = prefix_bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path())
    return prefix_bpe.encoded_digests(encoded)


@query("op5_secret_scan")
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secret_spans(table(spark, sf_dir, "documents"))
    base = [r.kind for r in secret_scan.BASE_RULES]

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")

    def number(kind: str) -> Column:
        own = F.filter("spans", lambda s: s.kind == kind)
        return F.size(own).cast("long").alias(f"n_{kind}")

    base_spans = F.filter("spans", lambda s: s.kind.isin(base))
    return found.select(
        "doc_id",
        *map(number, base),
        sha(listed(base_spans)).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


@query(
    "op9_decontaminate",
    r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, w[k:k + least(10, len(w)) - 1] AS g
  FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)),
n AS (SELECT DISTINCT n FROM p),
g AS (
  SELECT doc_id, n, k, w[k:k + n - 1] AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, n WHERE len(w) >= n)),
h AS (SELECT doc_id, k, g.n, item_id FROM g JOIN p ON g.n = p.n AND g.g = p.g),
c AS (SELECT doc_id, count(DISTINCT pos) AS n_hit
      FROM (SELECT doc_id, unnest(range(k, k + n)) AS pos FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
""",
)
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.hit_counts(
        decontaminate.contaminated_words(
            table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
        )
    )
    items = F.array_join(F.array_sort("items"), ",")
    return hits.select(
        "doc_id", "n_words", "n_hit", "n_items", sha(items).alias("items_sha256"), "contaminated"
    )


@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.graded(docs, model).select("doc_id", "toxicity.*")


@query(
    "op8_reply_trees",
    r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(regexp_replace(replace(x, '\', '\\'),
    '([<\[])(\|im_(?:start|sep|end)\||/?INST\]|/?s>)', '\1\\\2', 'g')) AS n
  FROM (SELECT *, role || chr(0) || text AS x FROM c))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n + 31)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
""",
)
def op8_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = [(-1, 0, "user", probe), (-1, 1, "assistant", probe)]
    turns = turns.unionByName(
        spark.createDataFrame(more, "conv_id long, turn long, role string, text string")
    )
    chats = reply_trees.format_chats(reply_trees.linear_messages(turns))
    read = chats.select(
        F.col("tree.conv").alias("conv_id"),
        "formatted",
        reply_trees.turns_read_back(F.col("formatted")).alias("turns"),
        reply_trees.learned_text(F.col("formatted"), F.col("loss_mask")).alias("learned"),
    )
    lines = F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        sha(F.array_join(lines, "")).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        sha(F.col("learned")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query(
    "op7_relative_lz",
    r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT doc_id, k, array_to_string(w[k:k + 12], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d WHERE len(w) >= 13)),
m AS (SELECT g, min(doc_id) AS first_doc FROM g GROUP BY g),
r AS (SELECT DISTINCT doc_id, unnest(range(k, k + 13)) AS pos FROM g JOIN m USING (g) WHERE first_doc < doc_id),
p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
k AS (
  SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.pos) FILTER (r.pos IS NULL) AS kept, count(r.pos) AS n_removed
  FROM p LEFT JOIN r ON p.doc_id = r.doc_id AND p.pos = r.pos GROUP BY p.doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
""",
)
def op7_relative_lz(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = relative_lz.substring_dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", sha(F.col("kept")).alias("kept_sha256"))


@query("op4_repeats")
def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = repeats.repeat_dedup(table(spark, sf_dir, "documents"))
    return kept.select(
        "doc_id",
        "n_bytes",
        "n_removed",
        F.size("starts").cast("long").alias("n_spans"),
        sha(F.col("kept")).alias("kept_sha256"),
    )


@query("op2_order_minhash")
def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_duplicates(table(spark, sf_dir, "documents")).drop("mark")


@query("op11_simhash")
def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return found.select("doc_id", digits, "component_id")


def kmeans_sql(rounds: int = hadamard_kmeans.ROUNDS) -> str:
    """One pair of tables for each round: assignments and the centroids after them."""

    def assignment(r: int) -> str:
        return f"""
a{r} AS MATERIALIZED (
  SELECT rid, vec_id, v, min(struct_pack(d := d, c := c)) AS m
  FROM (SELECT e.*, c.c, list_sum(list_transform(list_zip(e.v, c.v),
          lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM e, c{r} c)
  GROUP BY rid, vec_id, v)"""

    def centroids(r: int) -> str:
        return f"""
c{r + 1} AS MATERIALIZED (
  SELECT c{r}.c, coalesce(n.v, c{r}.v) AS v FROM c{r} LEFT JOIN (
    SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY pos) AS v
    FROM (SELECT c, pos, sum(x) AS s, count(*) AS n
          FROM (SELECT m.c AS c, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM a{r}) GROUP BY c, pos)
    GROUP BY c) n ON n.c = c{r}.c)"""

    steps = [f(r) for r in range(rounds) for f in (assignment, centroids)] + [assignment(rounds)]
    return f"""
WITH e AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id,
         list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h) - 1 AS c, v
  FROM (SELECT v, sha256('3:' || vec_id) AS h FROM e ORDER BY h LIMIT 8)),{",".join(steps)}
SELECT vec_id, m.c::INTEGER AS cluster, m.d AS distance,
       sum(m.d) OVER (PARTITION BY m.c)::BIGINT AS cluster_inertia, sum(m.d) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON c{rounds}.c = m.c
"""


@query("op12_hadamard_kmeans", kmeans_sql())
def op12_hadamard_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hadamard_kmeans.with_inertia(hadamard_kmeans.cluster(table(spark, sf_dir, "embeddings")))


@query(
    "op13_importance",
    r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
t AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)),
    lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))) AS crcs),
f AS (SELECT doc_id, unnest(w) AS word FROM d),
g AS (SELECT unnest(w) AS word FROM i),
b AS (
  SELECT word, xor(list_reduce(list_concat([4294967295], list_transform(range(1, len(h), 2),
      lambda k: ('0x' || substr(h, k, 2))::BIGINT)),
    lambda c, x: xor(crcs[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket
  FROM (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM f UNION SELECT word FROM g)), t),
s AS (SELECT bucket, count(*) AS s FROM f JOIN b USING (word) GROUP BY bucket),
u AS (SELECT bucket, count(*) AS t FROM g JOIN b USING (word) GROUP BY bucket),
n AS (SELECT (SELECT count(*) FROM f) AS s_all, (SELECT count(*) FROM g) AS t_all),
gain AS (
  SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1) * (s_all + 10000))::DOUBLE
    / ((s + 1) * (t_all + 10000))::DOUBLE))::BIGINT AS gain
  FROM s LEFT JOIN u USING (bucket), n),
w AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM f JOIN b USING (word) JOIN gain USING (bucket) GROUP BY doc_id),
x AS (
  SELECT d.doc_id, len(w) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE)
      / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN w ON w.doc_id = d.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
             count(*) FILTER (n_features >= 20) OVER () AS n_fit FROM x)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_features >= 20 AND place <= 10 * n_fit // 100 THEN place END AS rank
FROM r
""",
)
def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return importance.resampled(docs, target).select(
        "doc_id", "n_features", "weight", "score", F.col("rank").cast("long")
    )
