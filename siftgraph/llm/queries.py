"""Registered queries of the operators and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontaminate,
    fill_middle,
    gru_lm,
    hilbert,
    language_mixture,
    lz_fingerprint,
    nbsvm,
    near_dedup,
    page_wrappers,
    periodic_runs,
    raking,
    rlz,
    token_output,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def default_tokenizer() -> str:
    """The public vocabulary file of this installation; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def raking_sql(sweeps: int = 16) -> str:
    """Checking SQL of the raking: a fixed number of sweeps over the cells, each a window."""
    powers = raking.FLATTEN
    goals = ", ".join(
        f"pow(sum(tokens) OVER (PARTITION BY {d}), {p}) AS g_{d}, sum(tokens) OVER (PARTITION BY {d}) AS t_{d}"
        for d, p in powers.items()
    )
    # a category's goal is repeated in each of its cells, so its share is taken once per cell share
    scaled = ", ".join(f"g_{d} * total / sum(g_{d} * tokens / nullif(t_{d}, 0)) OVER () AS goal_{d}" for d in powers)
    steps = "w0 AS (SELECT *, CAST(tokens AS DOUBLE) AS w FROM goals)"
    k = 0
    for _ in range(sweeps):
        for d in powers:
            steps += (
                f", w{k + 1} AS MATERIALIZED (SELECT * REPLACE (coalesce(w * goal_{d} / "
                f"nullif(sum(w) OVER (PARTITION BY {d}), 0), w) AS w) FROM w{k})"
            )
            k += 1
    return f"""
    WITH d AS (
        SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang,
            CASE WHEN contains(text, ' | ') THEN 'table' WHEN contains(text, '!!') THEN 'shout'
                WHEN contains(text, 'Licensed under') THEN 'licence'
                WHEN regexp_matches(coalesce(text, ''), '[0-9]{{3}}') THEN 'data' ELSE 'prose' END AS topic,
            len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS n_tokens,
            CAST(('0x' || substr(md5('0|' || doc_id || '|' || md5(coalesce(text, ''))), 1, 13)) AS BIGINT) / pow(16, 13) AS u
        FROM documents
    ),
    cells AS (SELECT source, lang, topic, sum(n_tokens) AS tokens FROM d GROUP BY ALL),
    sums AS (SELECT *, {goals}, sum(tokens) OVER () AS total FROM cells),
    goals AS (SELECT *, {scaled} FROM sums),
    {steps},
    f AS (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN w / tokens END AS weight FROM w{k}),
    p AS (
        SELECT source, lang, topic, coalesce(weight, (SELECT min(weight) FROM f WHERE weight > 0)) AS weight,
            coalesce(weight, (SELECT min(weight) FROM f WHERE weight > 0)) / (SELECT max(weight) FROM f) AS prob
        FROM f
    )
    SELECT doc_id, source, lang, topic, CAST(n_tokens AS BIGINT) AS n_tokens, round(weight, 6) AS weight,
        round(prob, 6) AS probability, u < prob AS selected
    FROM d JOIN p USING (source, lang, topic)"""


WORDS_SQL = """
    SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
    FROM documents"""


@query(
    "op1_rlz_substring_dedup",
    sql=f"""
    WITH d AS ({WORDS_SQL}),
    win AS (
        SELECT doc_id, s, md5(array_to_string(list_slice(w, s, s + 19), ' ')) AS k
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20)
    ),
    later AS (
        SELECT doc_id, s FROM (
            SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS rn FROM win
        ) WHERE rn > 1
    ),
    gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM later),
    gone_lists AS (SELECT doc_id, list(p ORDER BY p) AS ps FROM gone GROUP BY doc_id),
    words AS (SELECT doc_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS p FROM d),
    kept AS (
        SELECT doc_id, string_agg(t, ' ' ORDER BY p) AS txt FROM words ANTI JOIN gone USING (doc_id, p)
        GROUP BY doc_id
    )
    SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
        sha256(coalesce(txt, '')) AS kept_sha256
    FROM d LEFT JOIN gone_lists USING (doc_id) LEFT JOIN kept USING (doc_id)""",
)
def op1_rlz_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that no earlier 20-word window repeats."""
    kept = rlz.remove_copies(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query(
    "op9_superminhash_near_dedup",
    sql="""
    WITH RECURSIVE d AS (
        SELECT doc_id, list_filter(string_split_regex(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
        FROM documents
    ),
    s AS (
        SELECT DISTINCT doc_id, md5(array_to_string(list_slice(w, i, i + 4), ' ')) AS k
        FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
    ),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    sets AS (SELECT doc_id, n, md5(string_agg(k, '' ORDER BY k)) AS h FROM s JOIN n USING (doc_id) GROUP BY ALL),
    cls AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY h) AS rep FROM sets),
    r AS (SELECT s.doc_id, k FROM s JOIN cls USING (doc_id) WHERE cls.doc_id = rep),
    both_ AS (
        SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM r a JOIN r b ON a.k = b.k AND a.doc_id < b.doc_id
        GROUP BY ALL
    ),
    link AS (
        SELECT a, b FROM both_ JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
        WHERE 100 * i >= 75 * (na.n + nb.n - i)
    ),
    e AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
    reach AS (
        SELECT DISTINCT a AS x, a AS y FROM e
        UNION
        SELECT reach.x, e.b FROM reach JOIN e ON reach.y = e.a
    ),
    comp AS (SELECT x, min(y) AS c FROM reach GROUP BY x)
    SELECT d.doc_id, coalesce(cls.n, 0) AS n_shingles, coalesce(c, rep, d.doc_id) AS component_id,
        d.doc_id = coalesce(c, rep, d.doc_id) AS kept, coalesce(rep, d.doc_id) AS class_id
    FROM d LEFT JOIN cls USING (doc_id) LEFT JOIN comp ON comp.x = cls.rep""",
)
def op9_superminhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate group of every document."""
    return near_dedup.near_duplicates(table(spark, folder, "documents"))


@query("op3_language_mixture")
def op3_language_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """Language and language shares of every document, learned from two thirds of the ids."""
    docs = table(spark, folder, "documents")
    fold = language_mixture.remainder("doc_id", 3)
    return language_mixture.identify(docs, docs.filter(fold != 1), fold == 1)


@query("op4_nbsvm_quality")
def op4_nbsvm_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every document, learned from the labels of two thirds of the ids."""
    docs = table(spark, folder, "documents")
    fold = language_mixture.remainder("doc_id", 3)
    labels = table(spark, folder, "labels").filter(fold != 1).select("doc_id", F.col("quality").alias("label"))
    return nbsvm.classify(docs, labels, fold == 1)


@query("op5_lz_fingerprint")
def op5_lz_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint of every document, against its edited text and the next document."""
    return lz_fingerprint.edited_fingerprints(table(spark, folder, "documents"))


@query("op10_token_output")
def op10_token_output(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's place in the token files, read back from them."""
    return token_output.encode_and_index(table(spark, folder, "documents"), default_tokenizer())


@query("op6_raked_mixture", sql=raking_sql())
def op6_raked_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """Calibrated drawing probability of every document, and whether it is drawn."""
    drawn = raking.draw(table(spark, folder, "documents"))
    return drawn.withColumns({c: F.round(c, 6) for c in ("weight", "probability")})


@query("op2_hilbert_shards")
def op2_hilbert_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Shard and place in it of every document, in Hilbert order of its metadata."""
    return hilbert.shard(table(spark, folder, "documents"))


LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def shingled_sql(table_name: str, key: str, words: str, parts: str) -> str:
    """CTEs ``words`` (key, w) and ``parts`` (key, p, k): lower-case words and 5-word shingles by place."""
    return f"""{words} AS (
        SELECT {key}, list_filter(string_split_regex({LOWER_SQL}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM {table_name}
    ),
    {parts} AS (
        SELECT {key}, i - 1 AS p, md5(array_to_string(list_slice(w, i, i + 4), ' ')) AS k
        FROM (SELECT {key}, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM {words} WHERE len(w) > 0)
    )"""


@query(
    "op8_simhash_decontamination",
    sql=f"""
    WITH {shingled_sql('documents', 'doc_id', 'd', 's')}, {shingled_sql('benchmark', 'item_id', 'b', 'bs')},
    bc AS (SELECT item_id, k, count(*) AS n FROM bs GROUP BY ALL),
    size AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY 1),
    hits AS (SELECT DISTINCT doc_id, item_id, p FROM s JOIN bc USING (k)),
    geo AS (
        SELECT DISTINCT doc_id, item_id, least(len(b.w), len(d.w)) AS n_words,
            greatest(least(len(b.w), len(d.w)) - 4, 1) AS width, greatest(len(d.w) - 4, 1) AS places
        FROM hits JOIN d USING (doc_id) JOIN b USING (item_id)
    ),
    cand AS (
        SELECT DISTINCT doc_id, item_id, n_words, width,
            unnest(range(greatest(p - width + 1, 0), least(p, places - width) + 1)) AS st
        FROM hits JOIN geo USING (doc_id, item_id)
    ),
    cnt AS (
        SELECT c.doc_id, c.item_id, c.st, c.n_words, c.width, s.k, count(*) AS n
        FROM cand c JOIN s ON s.doc_id = c.doc_id AND s.p >= st AND s.p < st + width GROUP BY ALL
    ),
    low AS (
        SELECT doc_id, item_id, st, n_words, width, sum(least(cnt.n, bc.n)) AS low FROM cnt JOIN bc USING (item_id, k) GROUP BY ALL
    ),
    alike AS (
        SELECT doc_id, item_id, st, n_words, low / (width + n_item - low)::DOUBLE AS similarity FROM low JOIN size USING (item_id)
        WHERE 100 * low >= 75 * (width + n_item - low)
    )
    SELECT doc_id, item_id, CAST(st AS BIGINT) AS start, CAST(n_words AS BIGINT) AS n_words, round(similarity, 9) AS similarity
    FROM alike QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, st) = 1""",
)
def op8_simhash_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Every benchmark item found in a document, with its best window."""
    found = decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "item_id", "start", "n_words", F.round("similarity", 9).alias("similarity"))


@query("op7_gru_language_model")
def op7_gru_language_model(spark: SparkSession, folder: str) -> DataFrame:
    """Log probability of every document under a unigram base and a recurrent model."""
    docs = table(spark, folder, "documents")
    return gru_lm.score(docs, language_mixture.remainder("doc_id", 7) == 2)


@query("op11_page_wrappers")
def op11_page_wrappers(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page, by the wrapper of its host."""
    return page_wrappers.extract(table(spark, folder, "pages")).select(
        "page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars")
    )


@query("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Periodic runs of every document, in a tenth of them planted, and the text without their repeats."""
    found = periodic_runs.find_runs(periodic_runs.with_planted_periods(table(spark, folder, "documents")))
    best = F.array_max(
        F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period")))
    )
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query(
    "op13_fill_middle",
    sql="""
    WITH d AS (
        SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
            regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w
        FROM documents
    ),
    hashed AS (
        SELECT *, len(w) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
            CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
        FROM d
    ),
    formed AS (
        SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
            CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50
                THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
        FROM hashed
    ),
    parts AS (
        SELECT *, array_to_string(w[1:a], '') AS prefix, array_to_string(w[a + 1:b], '') AS middle,
            array_to_string(w[b + 1:], '') AS suffix
        FROM formed
    )
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
        CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
            ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
        sha256(text) AS restored_sha256
    FROM parts""",
)
def op13_fill_middle(spark: SparkSession, folder: str) -> DataFrame:
    """Every document for fill-in-the-middle training, and the text rebuilt from it."""
    made = fill_middle.transform(table(spark, folder, "documents"))
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
