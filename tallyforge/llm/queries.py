"""One query of each operator over its whole table, with the columns that its contract names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import bpe, chats, fingerprints, jaccard, language, lattice, neighbours, notices, packing, periods, secrets, spelling, substrings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable:
    """Register a query, and the same in SQL where SQL can express it."""

    def register(make: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = make
        if oracle is not None:
            ORACLE[name] = oracle
        return make

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Path of a public vocabulary file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_language")
def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", language.held_out(F.col("doc_id")).alias("held_out"))
    model = language.fit(docs.where("NOT held_out").select(F.col("doc_id").alias("key"), "text", "lang"))
    out = language.predict(docs.select("doc_id", "held_out", "text"), model)
    return out.select("row.doc_id", "row.held_out", "lang_pred", "score")


@query("op2_jaccard_join")
def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_copies(documents(spark, sf_dir))


# A list of words as text is the same for DuckDB and Spark, and each window is one such text.
@query(
    "op4_substring_dedup",
    r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20),
    h AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 19], ' ')) AS k FROM s),
    o AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM h),
    g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM o WHERE n > 1),
    r AS (SELECT doc_id, list(p) AS gone FROM g GROUP BY doc_id),
    t AS (SELECT d.doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN r USING (doc_id))
    SELECT doc_id, len(w)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed,
           sha256(array_to_string(list_filter(w, lambda x, p: NOT list_contains(gone, p)), ' ')) AS kept_sha256 FROM t""",
)
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.without_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("row.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op5_bpe")
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode(documents(spark, sf_dir), vocabulary())
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op9_packing")
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(documents(spark, sf_dir), vocabulary())
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op8_lm_score")
def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``score`` is that of the weights learnt from training words; under the vocabulary's own ranks every text is far less likely."""
    out = lattice.score(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))
    return out.withColumn("vocabulary_score", F.col("score")).withColumn("score", F.col("adapted_score"))


@query("op7_secrets")
def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.find_narrow(documents(spark, sf_dir).select("doc_id", "text"), ["doc_id"])
    base = F.filter("spans", lambda s: s["kind"] < len(secrets.KINDS))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == secrets.ORDER[kind])).cast("long").alias(f"n_{kind}")

    return out.select(
        "row.doc_id", *map(count, secrets.KINDS), F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans")
    )


@query(
    "op10_chat_format",
    """WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  coalesce('+' || role, '-') || chr(1) || coalesce('+' || text, '-') || chr(2) AS k,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos FROM conversations),
    p AS (SELECT *, sha256(string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY pos)) AS h,
                 count(*) OVER (PARTITION BY conv_id) AS n_turns FROM t),
    w AS (SELECT n_turns, h, min(conv_id) AS conv_id FROM p WHERE pos = n_turns GROUP BY n_turns, h),
    m AS (SELECT conv_id, n_turns FROM w WHERE h NOT IN (SELECT h FROM p WHERE pos < n_turns)),
    r AS (SELECT m.conv_id, (t.pos - 1) // 1024 AS part, m.n_turns,
                 string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY t.pos) AS rendered, count(*) AS turns
          FROM m JOIN t USING (conv_id) GROUP BY ALL)
    SELECT conv_id, part, n_turns, turns, length(rendered)::BIGINT AS n_chars, sha256(rendered) AS sha256 FROM r""",
)
def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chats.collapse(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return out.select("conv_id", "part", "n_turns", "turns", F.length("rendered").cast("long").alias("n_chars"), F.sha2("rendered", 256).alias("sha256"))


@query("op6_fingerprints")
def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprints.fingerprints(documents(spark, sf_dir))
    kept, edited, following = F.col("kept"), F.col("edited_kept"), F.col("next_kept")
    return out.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.as_text(kept).alias("fingerprint"), fingerprints.as_text(edited).alias("edited_fingerprint"),
        fingerprints.likeness(kept, edited).alias("near_edited"), fingerprints.likeness(kept, following).alias("near_next"),
        fingerprints.containment(kept, edited).alias("kept_in_edited"),
    )


@query("op3_nearest_vectors")
def op3_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return neighbours.nearest(vectors, vectors.where("vec_id % 50 = 0"))


def crc32_sql(text: str) -> str:
    """SQL for the CRC-32 of a text expression of characters up to U+00FF, bit by bit, as DuckDB has no function for it."""
    code = "unicode(ch)"
    utf8 = f"CASE WHEN {code} < 128 THEN [{code}] ELSE [194 + {code} // 192, 128 + {code} % 64] END"
    bits = f"flatten(list_transform(flatten(list_transform(string_split({text}, ''), lambda ch: {utf8})), lambda b: [b::BIGINT, 0, 0, 0, 0, 0, 0, 0]))"
    step = "xor(xor(c, e) >> 1, 3988292384 * (xor(c, e) & 1))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {bits}), lambda c, e: {step}), 4294967295)"


# Every run matches itself 16 words long, so all pairs of equal 16 words, in stretches of one lag, hold every run.
@query(
    "op13_period_runs",
    rf"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {crc32_sql("doc_id::VARCHAR")} AS h FROM documents),
    k AS (SELECT doc_id, w, len(w) AS n, h, (h // 10) % len(w) AS a, 1 + (len(w) - (h // 10) % len(w)) // (3 + (h // 10) % 8) AS p FROM d),
    m AS (SELECT doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE w END AS w FROM k),
    g AS (SELECT doc_id, i, sha256(array_to_string(w[i + 1:i + 16], ' ')) AS gram FROM (SELECT doc_id, w, unnest(range(len(w) - 15)) AS i FROM m WHERE len(w) >= 16)),
    e AS (SELECT y.doc_id, y.i, y.i - x.i AS q FROM g x JOIN g y ON x.doc_id = y.doc_id AND x.gram = y.gram AND x.i < y.i),
    s AS (SELECT doc_id, i, q, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS stretch FROM e),
    r AS (SELECT doc_id, min(i) - q AS start, count(*) + 15 + q AS length, q FROM s GROUP BY doc_id, q, stretch),
    o AS (SELECT doc_id, start, length, min(q) AS period FROM r WHERE length >= greatest(24, 3 * q) GROUP BY doc_id, start, length),
    f AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS text,
                 first(struct_pack(start, length, period) ORDER BY (length::DECIMAL(38, 18) / period) DESC, start, period) AS best FROM o GROUP BY doc_id),
    x AS (SELECT doc_id, list(DISTINCT pos) AS gone FROM (SELECT doc_id, unnest(range(start + period, start + length)) AS pos FROM o) GROUP BY doc_id)
    SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.start::BIGINT AS start, best.length::BIGINT AS length, best.period::BIGINT AS period,
           (1000 * best.length // best.period)::BIGINT AS exponent_milli, sha256(coalesce(f.text, '')) AS runs_sha256,
           sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda t, j: NOT list_contains(gone, j - 1)) END, ' ')) AS collapsed_sha256
    FROM m LEFT JOIN f USING (doc_id) LEFT JOIN x USING (doc_id)""",
)
def op13_period_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    # Words from a on repeat with period p, in the documents that the contract chooses.
    planted = F.expr("transform(w, (x, i) -> IF(i < a, x, w[CAST(a + (i - a) % p AS INT)]))")
    chosen = (
        documents(spark, sf_dir).select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"))
        .withColumn("w", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("w")).withColumn("g", F.expr("h div 10"))
        .withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
        .select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(planted, " ")).otherwise(F.col("text")).alias("text"))
    )
    out = periods.periodic_runs(chosen).withColumn("best", periods.most_repeated(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))))
    text = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return out.select(
        "row.doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def _notice_sql() -> str:
    """Templates as rows, and the same choice of rare words, intersection and check by joins."""
    words = ", ".join(f"({i}, {at}, '{w}')" for i, t in enumerate(notices.TEMPLATES) for at, w in enumerate(t.words))
    kinds = ", ".join(
        f"({i}, '{t.label}', {t.base}, {len(t.words)}, {t.phrase_at}, {t.phrase_at + len(t.phrase.split())}, {t.text == t.phrase})"
        for i, t in enumerate(notices.TEMPLATES)
    )
    return rf"""WITH tw(t, rel, word) AS (VALUES {words}), tk(t, label, base, n, a, b, whole) AS (VALUES {kinds}),
    d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{notices.WORD.replace("x00", "x{0}")}') AS w FROM documents),
    u AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
    p AS (SELECT * FROM u WHERE word IN (SELECT word FROM tw)),
    f AS (SELECT word, count(DISTINCT doc_id) AS c FROM p GROUP BY word),
    l AS (SELECT t, word, min(rel) AS rel FROM tw GROUP BY t, word),
    r AS (SELECT t, l.word, rel, row_number() OVER (PARTITION BY t ORDER BY coalesce(c, 0), rel) AS place, least({notices.RARE}, count(*) OVER (PARTITION BY t)) AS k
          FROM l LEFT JOIN f ON l.word = f.word),
    s AS (SELECT doc_id, r.t, i - rel AS start FROM p JOIN r ON p.word = r.word JOIN tk ON r.t = tk.t WHERE place <= {notices.RARE}
          GROUP BY doc_id, r.t, start, k, whole HAVING count(*) >= CASE WHEN whole OR k < 3 THEN k ELSE 2 END),
    v AS (SELECT s.doc_id, s.t, s.start, label, base, count(p.word) / any_value(n)::DOUBLE AS share, count(p.word) FILTER (rel >= a AND rel < b) AS held, any_value(b - a) AS need
          FROM s JOIN tw ON s.t = tw.t JOIN tk ON s.t = tk.t LEFT JOIN p ON p.doc_id = s.doc_id AND p.i = s.start + rel AND p.word = tw.word GROUP BY ALL),
    m AS (SELECT * FROM v WHERE held = need AND share >= {notices.LEAST}),
    o AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
                 array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(share) AS score
          FROM m GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
           coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score FROM d LEFT JOIN o USING (doc_id)"""


@query("op12_license_notices", _notice_sql())
def op12_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = notices.find(documents(spark, sf_dir).select("doc_id", "text"))
    base = F.transform(F.filter("notices", lambda m: m["template"].isin([i for i, t in enumerate(notices.TEMPLATES) if t.base])), lambda m: m["start"].cast("long"))
    return out.select("row.doc_id", "n_words", "notices", base.alias("places")).select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places").alias("first_word"), F.array_max("places").alias("last_word"),
        notices.labels(F.col("notices"), base=True).alias("base_labels"), notices.labels(F.col("notices")).alias("labels"),
        F.coalesce(F.array_max(F.transform("notices", lambda m: m["share"])), F.lit(0.0)).alias("score"),
    )


# Deleting one code point gives the words themselves (insertions), or what two words have in common (replacements, at the same place).
@query(
    "op11_spelling_variants",
    rf"""WITH RECURSIVE r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                        '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents),
    c AS (SELECT doc_id, run, count(*) AS n FROM r WHERE length(run) >= 6 GROUP BY doc_id, run),
    h AS (SELECT run, n, {crc32_sql("(doc_id::VARCHAR || ':' || run)")} AS h FROM c),
    e AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM h),
    w AS (SELECT word, sum(n)::BIGINT AS n FROM e WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
    k AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
    p AS (SELECT a.word, b.word AS near, b.n AS near_n FROM k a JOIN k b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
          UNION SELECT k.word, w.word, w.n FROM k JOIN w ON k.rest = w.word
          UNION SELECT w.word, k.word, k.n FROM k JOIN w ON k.rest = w.word),
    s AS (SELECT word, count(*) AS n_near, first(struct_pack(near, near_n) ORDER BY near_n DESC, near) AS best FROM p GROUP BY word),
    f AS (SELECT w.word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN best.near_n >= 5 * n THEN best.near END AS form,
                 CASE WHEN best.near_n >= 5 * n THEN best.near_n END AS form_n FROM w LEFT JOIN s USING (word)),
    t AS (SELECT word, word AS root, form AS up FROM f UNION ALL SELECT t.word, f.word, f.form FROM t JOIN f ON t.up = f.word)
    SELECT f.word, f.form, t.root, f.n, f.n_near, f.form_n FROM f JOIN t ON f.word = t.word WHERE t.up IS NULL""",
)
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(documents(spark, sf_dir), planted=199))
