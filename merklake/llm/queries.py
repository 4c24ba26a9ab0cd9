"""The registered queries of this subpackage, and the SQL of those that SQL can express on whole tables."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merklake.llm import bpe, chat_format, decontaminate, divergence, importance, jaccard, language_model, neighbours, secrets, suffix_dedup, token_counts, toxicity, url_filter

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _digest(values, sep: str = ","):
    return F.sha2(F.array_join(values, sep), 256)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), "text")
    counted = token_counts.count_tokens(docs, VOCABULARY, ["doc_id", "n_bytes"])
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


TOOLS: chat_format.Schemas = {
    "lookup": {"query": chat_format.Parameter(least=1, most=400), "limit": chat_format.Parameter("integer", least=1, most=60)},
    "summarise": {"query": chat_format.Parameter(least=1), "exact": chat_format.Parameter("boolean", required=False)},
}


def tool_messages(conversations: DataFrame) -> DataFrame:
    """The table's turns as a chat with tools, since it has none: what a user says is also a call, which comes after the call of
    the user's turn before last, and what the assistant says next is its result."""
    call_id = F.concat_ws("-", "conv_id", "turn")
    words = F.size(F.split("text", r"\s+"))
    limit = F.when(words % 7 == 0, F.lit(None).cast("string")).when(words % 7 == 1, F.concat(words.cast("string"), F.lit(" rows"))).otherwise(words.cast("string"))
    name = F.when(F.char_length("text") % 5 == 0, "summarise").when(F.char_length("text") % 5 == 1, "remember").otherwise("lookup")
    arguments = F.when(name == "summarise", F.create_map(F.lit("query"), F.col("text"), F.lit("exact"), (words % 2 == 0).cast("string"))).otherwise(
        F.create_map(F.lit("query"), F.col("text"), F.lit("limit"), limit)
    )
    after = F.when(F.col("turn") >= 2, F.concat_ws("-", "conv_id", F.col("turn") - 2))
    call = F.struct(call_id.alias("id"), name.alias("name"), arguments.alias("arguments"), after.alias("after"))
    assistant = F.col("role") == "assistant"
    return conversations.select(
        "conv_id", "turn", F.when(assistant, "tool").otherwise(F.col("role")).alias("role"), "text",
        F.when(F.col("role") == "user", F.array(call)).alias("calls"), F.when(assistant, F.concat_ws("-", "conv_id", F.col("turn") - 1)).alias("call_id"),
    )


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_chats(tool_messages(_table(spark, sf_dir, "conversations")), TOOLS)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(_table(spark, sf_dir, "documents"), VOCABULARY, ["doc_id"])
    both = bpe.decode(encoded, VOCABULARY, out="decoded")
    return both.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), _digest(F.col("ids").cast("array<string>")).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), ["doc_id"])
    c = found.select("doc_id", "contamination.*")
    return c.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), _digest(F.col("items")).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = jaccard.link(_table(spark, sf_dir, "documents"), jaccard.Rule(words=3, percent=90))
    return jaccard.component_ids(linked).select("doc_id", "n_shingles", "component_id")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda s, x: s + x["end"] - x["start"])
    return found.select(
        "doc_id", (F.octet_length("kept") + removed).cast("bigint").alias("n_bytes"), removed.alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_table(spark, sf_dir, "documents"), ["doc_id"])
    base = F.filter("secrets", lambda s: s["kind"].isin(*secrets.BASE_KINDS))

    def written(spans):
        return F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))

    def count(kind):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    spans = F.array_join(written(F.col("secrets")), ",")
    return found.select("doc_id", *map(count, secrets.BASE_KINDS), _digest(written(base)).alias("base_sha256"), spans.alias("spans"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


URL_RULES = [
    url_filter.Rule("block", "net", "/"),
    url_filter.Rule("allow", "example.net", "/en/"),
    url_filter.Rule("block", "example.com", "/de/"),
    url_filter.Rule("allow", "org", "/fr/"),
]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables name no outcomes of pages; the labels of the document with a page's number stand for them."""
    labels = _table(spark, sf_dir, "labels")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
    return url_filter.judge(_table(spark, sf_dir, "pages"), outcomes, URL_RULES, ["page_id"]).drop("bad_bound")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")), ["doc_id"])
    score = F.col("toxicity.score")
    predicted = (score >= toxicity.THRESHOLD).cast("int")
    return scored.select("doc_id", F.coalesce(toxicity.is_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), score.alias("score"), predicted.alias("predicted"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents")).withColumn("rank", F.col("rank").cast("int"))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.draw(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return drawn.select("doc_id", "drawn.*")


LM_ORDER = 2  # README says why not 3


def op13_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    model = language_model.fit(docs.where(~held_out), LM_ORDER)
    scored = language_model.score(docs, model, ["doc_id"])
    train_tokens = F.lit(model.layout.vocabulary.tokens).cast("bigint").alias("train_tokens")
    return scored.select("doc_id", held_out.alias("held_out"), "model.n_tokens", "model.n_known", train_tokens, "model.base_score", "model.score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_chat_format": op2_chat_format,
    "op3_bpe": op3_bpe,
    "op4_decontamination": op4_decontamination,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_secret_scan": op7_secret_scan,
    "op8_nearest_neighbours": op8_nearest_neighbours,
    "op9_url_filter": op9_url_filter,
    "op10_toxicity": op10_toxicity,
    "op11_source_divergence": op11_source_divergence,
    "op12_resample": op12_resample,
    "op13_lm_score": op13_lm_score,
}

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

_DECONTAMINATION = f"""WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w, least(10, len({_WORDS})) AS n FROM benchmark),
windows AS MATERIALIZED (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM b WHERE n > 0)),
places AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM windows))),
hits AS MATERIALIZED (SELECT doc_id, i, n, item_id FROM places JOIN windows USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""


def _posterior(groups: str, above: str, key: str, name: str) -> str:
    """CTEs for one level of the hosts' names: prior strength, then a and b of every group's beta posterior."""
    return f"""{name}_k AS (SELECT *, bad / n AS r FROM (SELECT g.*, prior FROM {groups} g {above})),
{name}_x AS (SELECT (sum(n * (r - prior) * (r - prior)) - sum(prior * (1 - prior)))
    / nullif(sum(n * prior * (1 - prior)) - sum(prior * (1 - prior)), 0) AS x FROM {name}_k WHERE n > 0),
{name}_s AS (SELECT CASE WHEN x > 0 THEN greatest(1.0::DOUBLE, least(1000.0::DOUBLE, 1 / x - 1)) ELSE 1000.0::DOUBLE END AS s FROM {name}_x),
{name} AS (SELECT {key}, prior * s + bad AS a, (1 - prior) * s + n - bad AS b FROM {name}_k, {name}_s)"""


_URL_FILTER = f"""WITH p AS MATERIALIZED (SELECT page_id,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
l AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 1 AND toxic = 0 THEN 0 ELSE 1 END) AS bad FROM labels
  WHERE doc_id IS NOT NULL AND (quality = 1 AND toxic = 0) IS NOT NULL GROUP BY ALL),
c AS (SELECT host, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad FROM p LEFT JOIN l USING (page_id) GROUP BY host),
named AS (SELECT *, string_split(name, '.') AS w, regexp_matches(name, '^[0-9.]+$') AS numeric
  FROM (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name FROM c)),
doubled AS (SELECT *, array_to_string(w[-2:], '.') AS two, len(w) > 2 AND array_to_string(w[-2:], '.') IN ('{"', '".join(url_filter.DOUBLE_SUFFIXES)}') AS twofold FROM named),
h AS MATERIALIZED (SELECT host, n, bad,
  CASE WHEN numeric OR len(w) < 2 THEN '' WHEN twofold THEN two ELSE w[-1] END AS suffix,
  CASE WHEN numeric OR len(w) < 3 THEN name WHEN twofold THEN array_to_string(w[-3:], '.') ELSE two END AS domain FROM doubled),
total AS (SELECT (sum(bad) + 0.5) / (sum(n) + 1) AS prior FROM h),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL),
{_posterior("s", ", total", "suffix", "ps")},
{_posterior("d", "JOIN (SELECT suffix, a / (a + b) AS prior FROM ps) USING (suffix)", "domain, suffix", "pd")},
{_posterior("h", "JOIN (SELECT domain, suffix, a / (a + b) AS prior FROM pd) USING (domain, suffix)", "host", "ph")},
bounds AS (SELECT host, a / (a + b) - {url_filter.BOUND} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS bound FROM ph),
ruled AS (SELECT *, '.' || host AS h, CASE
    WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'allow example.net/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'block example.com/de/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'allow org/fr/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'block net/' END AS r FROM p JOIN bounds USING (host))
SELECT page_id, host, path, r[7:] AS rule,
  CASE WHEN r IS NOT NULL THEN r[:5] WHEN bound > {url_filter.LIMIT} THEN 'block' ELSE 'allow' END AS verdict FROM ruled"""

_SOURCE_DIVERGENCE = r"""WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
seen AS (SELECT lang, unnest(list_distinct(w)) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term FROM seen GROUP BY ALL HAVING count(*) >= 3),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY ALL),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(w) AS term FROM d) JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, sum(n) AS t FROM c GROUP BY ALL),
g AS (SELECT lang, source, coalesce(t, 0) AS t FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN totals USING (lang, source)),
p AS MATERIALIZED (SELECT lang, source, term, coalesce(n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(n, 0) + 1)::HUGEINT) // (t + v)::HUGEINT AS p
  FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
whole AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 1)::HUGEINT) // ((SELECT sum(t) FROM g WHERE g.lang = c.lang) + any_value(v))::HUGEINT AS q
  FROM c JOIN v USING (lang) GROUP BY lang, term),
summed AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value
  FROM p JOIN whole USING (lang, term) WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) QUALIFY part = 'pair' OR rank <= 200"""

# The others have no SQL of their own: merges, sampled suffixes, approximate and labelled neighbours and components are held
# against libraries, brute force and held-out labels in tests.
ORACLE_SQL: dict[str, str] = {"op4_decontamination": _DECONTAMINATION, "op9_url_filter": _URL_FILTER, "op11_source_divergence": _SOURCE_DIVERGENCE}
