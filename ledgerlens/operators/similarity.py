"""TF-IDF vectors as arrays, exact cosine pairs and search, duplicate scores and cost annotation.

Equal texts are collapsed first and carry their number of copies.  Pairs are pairs of distinct texts;
what happens inside a group of copies (similarity 1) follows from its size, so it is never spelled out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.numbers import ladder, rounded
from ledgerlens.functions.text import key_part, normalize_description
from ledgerlens.operators import postings, sparse
from ledgerlens.operators.quantiles import group_quantiles, join_null_safe
from ledgerlens.operators.ranking import sequence_rank
from ledgerlens.session import materialize

# Template texts, stop words and thresholds of the duplicate search.
GENERIC_TEMPLATES = [
    "construction of cc road", "cc road nirman", "solar light", "street lights", "muktidham nirman", "high mask light",
    "at public place", "purchase of books", "bus stand bus shed", "yatri prtikshalaya", "construction of community hall",
    "construction of stage for cultural activities", "new water tanker for panchayat",
    "ms pole with led semi high mast light", "as per attechment", "cc road", "drain nirman", "borewell", "bore well",
    "interlocking tiles", "hand pump",
]
STOP_WORDS = [
    "the", "a", "an", "and", "or", "but", "of", "to", "in", "for", "with", "at", "by", "from", "on", "is", "are", "was", "were", "be", "been", "being",
    "have", "has", "had", "do", "does", "did", "will", "would", "shall", "should", "may", "might", "can", "could", "this", "that", "these", "those", "it",
    "its", "work", "works", "project", "scheme", "proposed", "proposal", "recommended", "recommendation", "under", "near", "via", "as", "per", "ka", "ki",
    "ke", "se", "ko", "mein", "hai", "hain", "aur", "nirman", "karya", "yojana", "gram", "nagar",
]
MIN_LENGTH = 40
HIGH, CRITICAL = 0.85, 0.97


def clean_text(c: Column) -> Column:
    """Lower case, punctuation to blanks, blanks collapsed; letters of any script stay."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[^\w\s]", " "), r"\s+", " "))


def is_generic(c: Column) -> Column:
    """Short texts and texts that are, or start with, a template."""
    text = F.trim(F.lower(c))
    starts = [(text == t) | F.startswith(text, F.lit(t + " ")) for t in GENERIC_TEMPLATES]
    return c.isNull() | (F.length(text) < MIN_LENGTH) | reduce(lambda a, b: a | b, starts)


def specificity_weight(c: Column) -> Column:
    n = F.length(F.trim(c))
    weight = F.when(n < 20, 0.1).when(n < 40, 0.3).when(n < 80, 0.6).otherwise(1.0)
    return F.when(c.isNull() | (c == ""), 0.0).otherwise(weight)


def similarity_band(score: Column) -> Column:
    steps = [(0.80, "CRITICAL_DUPLICATE"), (0.60, "HIGH_SIMILARITY"), (0.40, "MEDIUM_SIMILARITY"), (0.10, "LOW_SIMILARITY")]
    return ladder(score, steps, "UNIQUE")


# --- vectors --------------------------------------------------------------------------------------


def with_clean_descriptions(works: DataFrame, description: str = "work_description") -> DataFrame:
    """Works with a non-empty normalised description in ``clean_description``."""
    return works.withColumn("clean_description", normalize_description(F.col(description))).filter("clean_description <> ''")


def distinct_texts(docs: DataFrame) -> DataFrame:
    """One row per distinct text: id (its smallest project id), text, copies."""
    return docs.groupBy(F.col("clean_description").alias("text")).agg(
        F.min("project_id").alias("text_id"), F.count("*").alias("copies")
    )


def term_counts(texts: DataFrame, stop_words: list[str], max_n: int, min_chars: int = 1) -> DataFrame:
    """Occurrences of every n-gram (1..max_n) per text, after removing stop words: text_id, copies, term, tf.

    All words of a text are in one row, so its terms are counted there; no single n-gram is shuffled or sorted.
    """
    # texts of one id count as one, but no n-gram reaches from one into the next
    placed = texts.groupBy("text_id", "copies").agg(F.collect_list(F.coalesce("text", F.lit(""))).alias("texts"))
    placed = placed.select("text_id", "copies", _words("texts", stop_words, min_chars).alias("parts"))
    kinds = ", ".join(f"{c} {placed.schema[c].dataType.simpleString()}" for c in ("text_id", "copies"))
    return placed.mapInArrow(lambda batches: _counted(batches, max_n), f"{kinds}, term string, tf long")


def _words(texts: str | Column, stop_words: list[str], min_chars: int) -> Column:
    """The words of each text of a list."""
    stop = F.array(*[F.lit(w) for w in stop_words])
    words = lambda text: F.filter(F.split(clean_text(text), " "), lambda w: (F.length(w) >= min_chars) & ~F.array_contains(stop, w))
    return F.transform(texts, words)


#: Words whose n-grams are counted at a time.
WORDS = 1 << 17


def _counted(batches: Iterator[pa.RecordBatch], max_n: int) -> Iterator[pa.RecordBatch]:
    for x in batches:
        for cut, words, row, left in postings.sliced_words(x, WORDS):
            terms, rows = postings.grams(words, row, left, max_n)
            table = pa.table({"row": rows, "term": terms})
            counts = table.group_by(["row", "term"], use_threads=False).aggregate([([], "count_all")]).sort_by("row").combine_chunks()
            for found in counts.to_batches():
                own = found.column("row")
                columns = [cut.column("text_id").take(own), cut.column("copies").take(own), found.column("term"), found.column("count_all")]
                yield pa.RecordBatch.from_arrays(columns, names=["text_id", "copies", "term", "tf"])


def numbered_texts(texts: DataFrame) -> DataFrame:
    """Texts written once, with a number of their own in ``doc``."""
    return materialize(texts.withColumn("doc", F.monotonically_increasing_id()), "texts")


def _listed(texts: DataFrame, stop_words: list[str], min_chars: int) -> DataFrame:
    """``doc, text_id, copies, parts`` of numbered texts; those of one id and as many copies are one, with their smallest number."""
    words = lambda df: df.select("doc", "text_id", "copies", _words("texts", stop_words, min_chars).alias("parts"))
    same = texts.groupBy("text_id", "copies").agg(F.min("doc").alias("__doc"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    same = materialize(same, "same")
    text = F.coalesce("text", F.lit(""))
    if same.isEmpty():
        return words(texts.select("doc", "text_id", "copies", F.array(text).alias("texts")))
    placed = join_null_safe(texts, same, ["text_id", "copies"])
    once = placed.where(F.col("__doc").isNull()).select("doc", "text_id", "copies", F.array(text).alias("texts"))
    more = placed.where(F.col("__doc").isNotNull()).groupBy(F.col("__doc").alias("doc"), "text_id", "copies").agg(F.collect_list(text).alias("texts"))
    return words(once.unionByName(more))


@dataclass
class TfIdf:
    """Fitted vocabulary (term, id, df, idf; ids rise with the class of df) and one vector per text (text_id, copies, doc, ids, weights)."""

    vocabulary: DataFrame
    vectors: DataFrame
    documents: int
    options: dict

    @property
    def weights(self) -> DataFrame:
        """The vectors as a long table: text_id, copies, term, df, weight."""
        rows = self.vectors.select("text_id", "copies", F.explode(F.arrays_zip("ids", "weights")).alias("e"))
        rows = rows.select("text_id", "copies", F.col("e.ids").alias("id"), F.col("e.weights").alias("weight"))
        return rows.join(self.vocabulary.select("id", "term", "df"), "id").select("text_id", "copies", "term", "df", "weight")


def fit_tfidf(
    texts: DataFrame, stop_words: list[str] | None = None, max_n: int = 3, min_df: int = 2, max_df: float = 0.8,
    max_features: int | None = None, sublinear: bool = True, min_chars: int = 1,
) -> TfIdf:
    """Smoothed idf over all documents (copies count), L2 rows, all usable terms.

    ``max_features`` keeps only the terms with the most occurrences, for results that are to agree with such a vocabulary. Terms get
    numbers in order of rarity, whatever the size of the vocabulary. Vectors are written to the shared folder once; texts too, unless they
    come from ``numbered_texts``.
    """
    if stop_words is None:
        stop_words = StopWordsRemover.loadDefaultStopWords("english")
    options = {"stop_words": stop_words, "max_n": max_n, "sublinear": sublinear, "min_chars": min_chars}
    if max_features is None:
        numbered = texts if "doc" in texts.columns else numbered_texts(texts)
        documents, characters = numbered.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
        vocabulary, vectors = postings.fitted(_listed(numbered, stop_words, min_chars), max_n, documents, characters, min_df, max_df, sublinear)
        return TfIdf(vocabulary, vectors, documents, options)
    documents = texts.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    counts = materialize(term_counts(texts, stop_words, max_n, min_chars), "terms")
    stats = counts.groupBy("term").agg(F.sum("copies").alias("df"), F.sum(F.col("tf") * F.col("copies")).alias("__total"))
    usable = stats.filter((F.col("df") >= min_df) & (F.col("df") <= max_df * documents))
    usable = usable.orderBy(F.desc("__total"), "term").limit(max_features)
    idf = (F.log((1.0 + documents) / (1 + F.col("df"))) + 1).alias("idf")
    vocabulary = materialize(sequence_rank(usable.select("term", "df", idf), [F.asc("df"), F.asc("term")], "id"), "vocabulary")
    return TfIdf(vocabulary, _vectors(counts, vocabulary, sublinear), documents, options)


def _vectors(counts: DataFrame, vocabulary: DataFrame, sublinear: bool) -> DataFrame:
    """One row per text with a usable term."""
    tf = 1 + F.log("tf") if sublinear else F.col("tf").cast("double")
    raw = counts.join(vocabulary.select("term", "id", "idf"), "term").select("text_id", "copies", "id", (tf * F.col("idf")).alias("raw"))
    listed = raw.groupBy("text_id", "copies").agg(F.sort_array(F.collect_list(F.struct("id", "raw"))).alias("v"))
    return materialize(sparse.unit_vectors(listed, "id", "raw").withColumn("doc", F.monotonically_increasing_id()), "vectors")


def query_vectors(queries: DataFrame, model: TfIdf) -> DataFrame:
    """Vectors of new texts (text_id, text) in the fitted vocabulary."""
    o = model.options
    counts = term_counts(queries.withColumn("copies", F.lit(1)), o["stop_words"], o["max_n"], o["min_chars"])
    return _vectors(counts, model.vocabulary, o["sublinear"])


def search(queries: DataFrame, model: TfIdf, threshold: float, index: sparse.BlockIndex | None = None) -> DataFrame:
    """query_id, text_id, similarity: indexed texts whose cosine to a query text (text_id, text) is at least ``threshold``.

    ``threshold`` is above 0. ``index`` (``sparse.block_index(model.vectors)``) can be built once for several searches; without one,
    the queries meet the vectors block by block, which reads them once.
    """
    asked = query_vectors(queries, model)
    sought = asked.withColumn("least", F.lit(float(threshold)))
    hits = sparse.within(sought, model.vectors) if index is None else sparse.search(sought, index)
    named = hits.join(asked.select(F.col("doc").alias("a"), F.col("text_id").alias("query_id")), "a")
    return named.join(model.vectors.select(F.col("doc").alias("b"), "text_id"), "b").select("query_id", "text_id", "similarity")


# --- pairs ----------------------------------------------------------------------------------------


def cosine_pairs(vectors: DataFrame, threshold: float = HIGH) -> DataFrame:
    """All pairs of distinct texts with cosine >= ``threshold``: text_id_a < text_id_b, similarity."""
    pairs = sparse.cosine_join(vectors, threshold)
    for side in ("a", "b"):
        pairs = pairs.join(vectors.select(F.col("doc").alias(side), F.col("text_id").alias(f"__{side}")), side)
    ends = F.least("__a", "__b").alias("text_id_a"), F.greatest("__a", "__b").alias("text_id_b")
    return materialize(pairs.select(*ends, "similarity"), "pairs")


def nearest_similarity(texts: DataFrame, vectors: DataFrame) -> DataFrame:
    """Largest cosine of each text to any other document: text_id, similarity.

    Copies are at 1; texts without terms, or that share none, get 0. The others meet all texts block by block.
    """
    alone = vectors.filter("copies = 1").select("doc", "text_id")
    shared = sparse.shared_terms(vectors)
    found = sparse.nearest(shared.join(alone.select("doc"), "doc", "left_semi"), shared).join(alone, "doc").select("text_id", "similarity")
    best = texts.select("text_id", "copies").join(found, "text_id", "left")
    return best.select("text_id", F.when(F.col("copies") > 1, 1.0).otherwise(F.coalesce("similarity", F.lit(0.0))).alias("similarity"))


def description_similarity(works: DataFrame, stop_words: list[str] | None = None, max_features: int | None = None) -> DataFrame:
    """Per work with a description: cosine to its nearest peer over (1,2)-gram TF-IDF."""
    docs = with_clean_descriptions(works)
    texts = numbered_texts(distinct_texts(docs))
    model = fit_tfidf(texts, stop_words, 2, 1, 1.0, max_features, sublinear=False, min_chars=2)
    best = nearest_similarity(texts, model.vectors).join(texts, "text_id").select("text", "similarity")
    return (
        docs.join(best, F.col("clean_description") == F.col("text"))
        .drop("text")
        .withColumnRenamed("similarity", "description_similarity_score")
    )


def text_pairs(docs: DataFrame, pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Annotated pairs of distinct texts, shown by their first projects, with copies on both sides.

    A text that several projects share also appears once with itself at similarity 1.
    """
    info = [c for c in ("state", "constituency", "mp_name") if c in docs.columns]
    rows = docs.select("project_id", "clean_description", *info)
    if "mp_name" not in info:
        rows = rows.withColumn("mp_name", key_part(F.col("project_id"), 2))
    head = rows.join(texts.select(F.col("text_id").alias("project_id"), "copies"), "project_id")
    # the smallest id is unique among projects, so this keeps one row per text
    for c in ("state", "constituency"):
        if c not in info:
            head = head.withColumn(c, F.lit(""))
    own = head.filter("copies > 1").select(
        F.col("project_id").alias("text_id_a"), F.col("project_id").alias("text_id_b"), F.lit(1.0).alias("similarity")
    )
    both = pairs.select("text_id_a", "text_id_b", "similarity").unionByName(own)
    for side in ("a", "b"):
        described = head.select(
            F.col("project_id").alias(f"text_id_{side}"), F.col("clean_description").alias(f"description_{side}"),
            F.col("state").alias(f"state_{side}"), F.col("constituency").alias(f"constituency_{side}"),
            F.col("mp_name").alias(f"mp_{side}"), F.col("copies").alias(f"copies_{side}"),
        )
        both = both.join(described, f"text_id_{side}")
    a, b, s = F.col("description_a"), F.col("description_b"), F.col("similarity")
    generic_a, generic_b = is_generic(a), is_generic(b)
    return both.select(
        F.col("text_id_a").alias("project_id_a"), F.col("text_id_b").alias("project_id_b"),
        a.alias("description_a"), b.alias("description_b"), F.left(a, F.lit(200)).alias("shown_a"), F.left(b, F.lit(200)).alias("shown_b"),
        rounded(s, 4).alias("similarity_score"),
        (s >= CRITICAL).cast("int").alias("exact_text_duplicate_flag"),
        (s >= HIGH).cast("int").alias("high_text_similarity_flag"),
        generic_a.alias("is_generic_a"), generic_b.alias("is_generic_b"),
        (generic_a | generic_b).cast("int").alias("generic_template_pair_flag"),
        (~generic_a & ~generic_b).alias("both_specific"),
        rounded((specificity_weight(a) + specificity_weight(b)) / 2, 4).alias("specificity_weight"),
        *[f"{c}_{side}" for c in ("state", "constituency", "mp", "copies") for side in ("a", "b")],
    )


def duplicate_scores(docs: DataFrame, texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Anomaly score per project from the numbers of high and critical matches, copies included."""
    sizes = texts.select("text_id", "copies")
    side = lambda x, y: pairs.select(F.col(f"text_id_{x}").alias("text_id"), F.col(f"text_id_{y}").alias("other"), "similarity")
    matches = (
        side("a", "b").unionByName(side("b", "a"))
        .join(sizes.withColumnsRenamed({"text_id": "other", "copies": "__n"}), "other")
        .groupBy("text_id")
        .agg(
            F.sum(F.when(F.col("similarity") >= HIGH, F.col("__n"))).alias("__high"),
            F.sum(F.when(F.col("similarity") >= CRITICAL, F.col("__n"))).alias("__critical"),
        )
    )
    per_text = texts.join(matches, "text_id", "left")
    count = lambda c: F.coalesce(c, F.lit(0)) + F.col("copies") - 1
    raw = F.least(F.lit(1.0), (count("__critical") * 0.6 + count("__high") * 0.3) / 10)
    score = F.when(is_generic(F.col("text")), 0.05).otherwise(rounded(raw * specificity_weight(F.col("text")), 4))
    scored = per_text.select("text", score.alias("similarity_anomaly_score"))
    return (
        docs.join(scored, F.col("clean_description") == F.col("text"))
        .select("project_id", "similarity_anomaly_score")
        .withColumn("similarity_risk_band", similarity_band(F.col("similarity_anomaly_score")))
    )


def related_projects(project_id: str, docs: DataFrame, texts: DataFrame, model: TfIdf, threshold: float = HIGH, index: sparse.BlockIndex | None = None) -> DataFrame:
    """Every project whose text is ``threshold`` alike one project's: its copies at 1, then the members of matching texts.

    Only this text is searched: in ``index`` if there is one, else all vectors are read once.
    """
    mine = materialize(docs.filter(F.col("project_id") == project_id).select("clean_description"), "mine")
    # written first: what one project finds is small as a rule, and its real size decides how it is joined
    me = materialize(texts.join(mine, F.col("text") == F.col("clean_description"), "left_semi").select("text_id"), "me")
    asked = materialize(model.vectors.join(me, "text_id", "left_semi").withColumn("least", F.lit(float(threshold))), "asked")
    hits = (sparse.scan(asked, model.vectors) if index is None else sparse.search(asked, index)).filter("a <> b").select(F.col("b").alias("doc"), "similarity")
    hits = materialize(hits, "hits")
    own = me.select("text_id", F.lit(1.0).alias("similarity"))
    matched = materialize(model.vectors.select("doc", "text_id").join(hits, "doc").select("text_id", "similarity").unionByName(own), "matched")
    matched = materialize(matched.join(texts.select("text_id", "text"), "text_id"), "matched")
    return (
        docs.join(matched, F.col("clean_description") == F.col("text"))
        .filter(F.col("project_id") != project_id)
        .select(F.lit(project_id).alias("project_id"), F.col("project_id").alias("other_id"), rounded(F.col("similarity"), 4).alias("similarity_score"))
    )


def similarity_summary(scores: DataFrame, pairs: DataFrame) -> DataFrame:
    """Projects per band, and pair counts, as (metric, count, pct).  A text's copies count all their mutual pairs."""
    bands = ["CRITICAL_DUPLICATE", "HIGH_SIMILARITY", "MEDIUM_SIMILARITY", "LOW_SIMILARITY", "UNIQUE"]
    per_band = scores.agg(
        F.count("*").alias("__total"), *[F.count_if(F.col("similarity_risk_band") == b).alias(b) for b in bands]
    )
    same = F.col("project_id_a") == F.col("project_id_b")
    n = F.when(same, F.col("copies_a") * (F.col("copies_a") - 1) / 2).otherwise(F.col("copies_a") * F.col("copies_b")).cast("long")
    inflated = F.col("budget_anomaly_label").isin("HIGH_BUDGET_INFLATION", "CRITICAL_BUDGET_INFLATION")
    total = lambda when: F.coalesce(F.sum(F.when(when, n)), F.lit(0))
    per_pair = pairs.agg(
        total(F.lit(True)).alias("__pairs"),
        total(~F.col("mp_a").eqNullSafe(F.col("mp_b"))).alias("cross"),
        total(F.col("geo_relationship") == "SAME_CONSTITUENCY").alias("same"),
        total(inflated).alias("inflated"),
    )
    row = lambda metric, count, base: F.struct(
        F.lit(metric).alias("metric"), count.alias("count"), rounded(count / F.greatest(base, F.lit(1)) * 100, 2).alias("pct")
    )
    all_, found = F.col("__total"), F.col("__pairs")
    entries = [row(f"Projects in {b}", F.col(b), all_) for b in bands] + [
        row("Total duplicate pairs found", found, all_),
        row("Cross-MP duplicate pairs", F.col("cross"), found),
        row("Same-constituency duplicate pairs", F.col("same"), found),
        row("Pairs with budget inflation anomaly", F.col("inflated"), found),
    ]
    both = per_band.withColumn("__one", F.lit(1)).join(per_pair.withColumn("__one", F.lit(1)), "__one")
    return both.select(F.inline(F.array(*entries)))


# --- cost -----------------------------------------------------------------------------------------


def annotate_costs(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """Recommended amounts of both projects, their ratio and the inflation label (checked from 0.85 up)."""
    out = pairs
    for side in ("a", "b"):
        cost = features.select(F.col("project_id").alias(f"project_id_{side}"), F.col("recommended_amount").alias(f"cost_{side}"))
        out = out.join(cost, f"project_id_{side}", "left").withColumn(f"cost_{side}", F.coalesce(f"cost_{side}", F.lit(0.0)))
    low, high = F.least("cost_a", "cost_b"), F.greatest("cost_a", "cost_b")
    out = out.withColumn("cost_ratio", F.when(low > 0, rounded(high / low, 4)).otherwise(0.0))
    ratio = F.col("cost_ratio")
    label = (
        F.when(F.col("similarity_score") < HIGH, "NOT_CHECKED")
        .when(ratio <= 0, "MISSING_COST")
        .when(ratio > 10, "CRITICAL_BUDGET_INFLATION")
        .when(ratio > 2, "HIGH_BUDGET_INFLATION")
        .otherwise("NORMAL_COST")
    )
    return out.withColumn("budget_anomaly_label", label)


def pair_cost_risk(similarity: Column, ratio: Column, geo_weight: Column) -> Column:
    factor = F.when(ratio <= 1, 0.0).when(ratio >= 10, 1.0).otherwise((ratio - 1) / 9)
    return rounded(F.least(F.lit(1.0), (similarity * 0.6 + factor * 0.4) * geo_weight), 4)


def peer_deviation(features: DataFrame) -> DataFrame:
    """Robust distance of the amount from the (state, category) median in peer deviations, label and 0..1 score.

    Rows without a state or category have no peers: null score, NORMAL_COST.
    """
    keys = ["state", "category"]
    df = features.select("project_id", *keys, F.coalesce("recommended_amount", F.lit(0.0)).alias("recommended_amount"))
    grouped = df.filter(F.col("state").isNotNull() & F.col("category").isNotNull())
    spread = grouped.groupBy(*keys).agg(F.stddev_samp("recommended_amount").alias("__std"))
    std = F.when(F.coalesce("__std", F.lit(1.0)) == 0, 1.0).otherwise(F.coalesce("__std", F.lit(1.0)))
    peers = join_null_safe(spread, group_quantiles(grouped, keys, "recommended_amount", {"peer_median": 0.5}), keys)
    out = df.join(peers.withColumn("peer_std", std).drop("__std"), keys, "left")
    out = out.withColumn("cost_z_score", rounded((F.col("recommended_amount") - F.col("peer_median")) / F.col("peer_std"), 4))
    size = F.abs("cost_z_score")
    return out.select(
        "project_id", "recommended_amount", "peer_median", "peer_std", "cost_z_score",
        ladder(size, [(3, "CRITICAL_COST"), (2, "HIGH_COST"), (1, "MEDIUM_COST")], "NORMAL_COST").alias("cost_deviation_label"),
        F.when(size.isNotNull(), rounded(F.least(size, F.lit(6.0)) / 6, 4)).alias("peer_deviation_score"),
    )
