"""Resume, routing, screening statistics, selection and balanced sampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from figcorpus.functions import text as tx
from figcorpus.functions.draws import draw
from figcorpus.operators.ranking import with_position
from figcorpus.session import durable

# fixed values
KEEP_CHART_TYPES = (1, 2, 6, 9, 11)
COMPLIANCE_LEVELS = (9, 10)
PARSE_STATES = ("done", "processing", "failed", "pending", "waiting-file")
INCOMPLETE_STATES = ("processing", "pending", "waiting-file", "uploading", "queued", "initializing")


# ---- resume and routing --------------------------------------------------------------


def pending(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without output yet."""
    return df.join(done.select(*keys).distinct(), keys, "left_anti")


def _probe(keys: list[str], words: int) -> list[Column]:
    """A key's word of the filter, and its four bits in there."""
    more = F.xxhash64(F.lit(1), *keys)
    ones = [
        F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftright(more, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
        for i in range(4)
    ]
    return [
        F.pmod(F.xxhash64(*keys), F.lit(words).cast("bigint")).alias("__word"),
        reduce(lambda a, b: a.bitwiseOR(b), ones).alias("__bits"),
    ]


def key_filter(done: DataFrame, keys: list[str], words: int) -> DataFrame:
    """Bloom filter of the keys as a table of at most ``words`` rows: ``__word`` and the bits ``__held`` set in it.

    A key's bits lie in one word, so tasks combine their words before the shuffle, filters
    of two runs merge by another ``bit_or``, and a probe is an equality on the word.
    """
    return done.select(*_probe(keys, words)).groupBy("__word").agg(F.bit_or("__bits").alias("__held"))


def split_by_filter(df: DataFrame, held: DataFrame, keys: list[str], words: int) -> tuple[DataFrame, DataFrame]:
    """(rows whose key the filter surely does not hold, rows whose key it may hold)."""
    marked = df.select("*", *_probe(keys, words)).join(F.broadcast(held), "__word", "left")
    maybe = F.coalesce(F.col("__held").bitwiseAND(F.col("__bits")) == F.col("__bits"), F.lit(False))
    return marked.where(~maybe).select(*df.columns), marked.where(maybe).select(*df.columns)


def pending_by_filter(df: DataFrame, done: DataFrame, keys: list[str], max_words: int = 1 << 20) -> DataFrame:
    """As :func:`pending`, but rows that a filter over the done keys denies are not shuffled.

    For runs in which most rows are still to do: only rows that the filter may hold, those
    done and a few per cent of the others, meet the done keys in the exact anti join. The filter takes
    about 16 bits a key and is broadcast, ``max_words`` rows at most; where the done keys would fill it
    beyond 8 to a word, or the two sides' key types differ, all rows go through the anti join. Null keys are
    never done. The rows are read twice, once for either branch.
    """
    n = done.agg(F.approx_count_distinct(F.xxhash64(*keys)).alias("n")).first()["n"]
    same = all(df.schema[k].dataType == done.schema[k].dataType for k in keys)
    if not same or n > 8 * max_words:
        return pending(df, done, keys)
    words = min(max_words, max(n // 4, 1))
    denied, maybe = split_by_filter(df, durable(key_filter(done, keys, words)), keys, words)
    return denied.unionByName(pending(maybe, done, keys))


def pending_groups(df: DataFrame, done: DataFrame, group: str, keys: list[str]) -> DataFrame:
    """All rows of every group that is not complete."""
    marked = df.join(done.select(*keys).distinct().withColumn("_done", F.lit(1)), keys, "left")
    incomplete = marked.where("_done IS NULL").select(group).distinct()
    return df.join(incomplete, group, "left_semi")


def quarantine(df: DataFrame, failed: Column) -> tuple[DataFrame, DataFrame]:
    """(good rows, failed rows with their whole input); NULL conditions count as good."""
    bad = F.coalesce(failed, F.lit(False))
    return df.where(~bad), df.where(bad)


def missing(wanted: DataFrame, have: DataFrame, keys: list[str]) -> DataFrame:
    """Wanted keys that have no match."""
    return wanted.join(have.select(*keys).distinct(), keys, "left_anti")


def matched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows paired by key."""
    return left.join(right, keys)


def select_by_index(files: DataFrame, index: DataFrame, nested: bool = True) -> DataFrame:
    """Files named by an index: by (book, image) in nested folders, by book in flat ones."""
    keys = ["book_id", "image_id"] if nested else ["book_id"]
    return files.join(index.select(*keys).distinct(), keys, "left_semi")


def copy_stats(index: DataFrame, files: DataFrame, n_subdirs: Column) -> DataFrame:
    """Processed, copied and missing index lines; rate is copied / folders / lines x 100."""
    have = files.select("book_id", "image_id").distinct().withColumn("_have", F.lit(1))
    folders = files.agg(n_subdirs.alias("total_subdirs"))
    totals = index.join(have, ["book_id", "image_id"], "left").agg(
        F.count("*").alias("total_processed"), F.count("_have").alias("files_copied")
    )
    both = totals.unionByName(folders, allowMissingColumns=True).agg(
        *[F.max(c).alias(c) for c in ("total_processed", "files_copied", "total_subdirs")]
    )
    return both.withColumn("missing_count", F.col("total_processed") - F.col("files_copied")).withColumn(
        "success_rate",
        F.when(
            (F.col("total_subdirs") > 0) & (F.col("total_processed") > 0),
            F.col("files_copied") / F.col("total_subdirs") / F.col("total_processed") * 100,
        ).otherwise(F.lit(0.0)),
    )


def screen_files(files: DataFrame, min_bytes: int = 5 * 1024 * 1024, path: str = "path", size: str = "length") -> DataFrame:
    """Verdict per file: too small, not a pdf, or keep; the size is looked at first."""
    return files.withColumn(
        "reason",
        F.when(F.col(size) < min_bytes, "too small").when(
            ~F.lower(F.col(path)).endswith(".pdf"), "not a pdf"
        ),
    ).withColumn("keep", F.col("reason").isNull())


def restore_kept(files: DataFrame, verdict: str = "verdict") -> DataFrame:
    """Kept and uncertain files survive."""
    return files.where(F.col(verdict).isin("keep", "uncertain"))


def tag_and_split(evals: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Ids from the path, then (compliant rows, the rest)."""
    ids = tx.ids_from_path(path)
    tagged = evals.withColumn("book_id", ids["book_id"]).withColumn("image_id", ids["image_id"])
    yes = F.coalesce(F.col("is_compliant") == "yes", F.lit(False))
    return tagged.where(yes), tagged.where(~yes)


def route_documents(docs: DataFrame, size_mb: str, pages: str, max_mb: float = 200, max_pages: int = 600) -> DataFrame:
    """Unreadable documents are skipped, oversized ones are split, others pass."""
    return docs.withColumn(
        "route",
        F.when((F.col(pages) == 0) | (F.col(size_mb) == 0), "skip")
        .when((F.col(size_mb) > max_mb) | (F.col(pages) > max_pages), "split")
        .otherwise("pass"),
    )


# ---- statistics ----------------------------------------------------------------------


def drop_sentinels(levels: DataFrame, col: str) -> DataFrame:
    return levels.where(F.col(col) != -1)


def histogram_pct(df: DataFrame, col: str, multi: bool = False) -> DataFrame:
    """Count and share of label occurrences per value; a row may hold several labels."""
    values = df.select(F.explode(col).alias("value")) if multi else df.select(F.col(col).alias("value"))
    counts = values.where("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("n"))
    # One row per label of the taxonomy is left, so the total over them needs no second scan.
    return counts.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(W.partitionBy()))


def describe_levels(df: DataFrame, cols: list[str]) -> DataFrame:
    """n, mean, median, min, max and sample deviation (0 for one row) of each level column.

    The median is exact: an integer level has few values, so its counts stay small.
    """
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("v")) for c in cols])).alias("x"))
    return (
        rows.select("x.metric", "x.v")
        .where("v IS NOT NULL")
        .groupBy("metric")
        .agg(
            F.count("v").alias("n"),
            F.avg("v").alias("mean"),
            F.median("v").alias("median"),
            F.min("v").alias("min"),
            F.max("v").alias("max"),
            F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("stdev"),
        )
    )


def level_summary(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count("*").alias("n"))


def state_counts(df: DataFrame, col: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows per processing state, 0 for states without rows, and how many are unfinished."""
    counts = [
        F.count_if(F.col(col) == s).alias(s.replace("-", "_")) for s in PARSE_STATES
    ]
    return df.groupBy(*by).agg(
        *counts, F.count_if(F.col(col).isin(*INCOMPLETE_STATES)).alias("incomplete")
    )


# ---- order, selection, sampling --------------------------------------------------------


def top_complex(screen: DataFrame, n: int = 20000, levels=COMPLIANCE_LEVELS) -> DataFrame:
    """The n most complex images of the given compliance levels; ties go by key."""
    return (
        screen.where(F.col("compliance_level").isin(*levels) & F.col("complexity_level").isNotNull())
        .orderBy(F.desc("complexity_level"), "book_id", "image_id")
        .limit(n)
    )


def sort_by_complexity(df: DataFrame) -> DataFrame:
    return df.orderBy("complexity_level", "book_id", "image_id")


def index_within_level(df: DataFrame, level: str = "complexity_level", keys=("book_id", "image_id")) -> DataFrame:
    """Running number inside each level."""
    return with_position(df, list(keys), (level,), "level_index")


def sample_by_hash(df: DataFrame, keys: list[str], k: int, seed: int = 0) -> DataFrame:
    """A given number of rows picked by a seeded hash: random, yet the same on every run."""
    return df.orderBy(draw(*keys, seed=seed), *keys).limit(k)


def sample_books(books: DataFrame, pct: float, key: str = "book_id", seed: int = 0) -> DataFrame:
    """max(1, pct percent) of the given books. The number grows with the books, so they are
    ranked by hash across partitions rather than sorted in one place."""
    k = max(1, int(books.count() * pct / 100))
    ranked = with_position(books, [draw(key, seed=seed), key], (), "_rank")
    return ranked.where(F.col("_rank") <= k).drop("_rank")


def sample_symbols(symbols: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n listed symbols: no special-treatment names, listed before 2020."""
    ok = ~F.col("name").contains("ST") & (F.col("list_date") < F.lit("2020-01-01").cast("date"))
    return sample_by_hash(symbols.where(ok), ["symbol"], n, seed)


def abnormal_sample_summary(per_book: DataFrame, sampled: DataFrame, pct: float) -> DataFrame:
    """Totals of the books with abnormal images and of the sample drawn from them."""
    marked = per_book.join(sampled.select("book_id").withColumn("_in", F.lit(1)), "book_id", "left")
    return marked.agg(
        F.count("*").alias("total_books"),
        F.coalesce(F.sum("n_abnormal"), F.lit(0)).alias("total_abnormal"),
        F.count("_in").alias("sampled_books"),
        F.coalesce(F.sum(F.when(F.col("_in") == 1, F.col("n_abnormal"))), F.lit(0)).alias("sampled_abnormal"),
    ).withColumn("percentage", F.lit(float(pct)))


def balanced_sample(
    images: DataFrame,
    limit: int = 200,
    keep_charts=KEEP_CHART_TYPES,
    priority=("complexity_level", "book_id", "image_id"),
    max_themes: int = 1000,
) -> DataFrame:
    """In order of complexity each image takes the first of its themes that has room.

    That sequential rule has one outcome, found here in rounds: every theme keeps its
    ``limit`` best takers and closes behind the last of them; images behind a closed
    theme's cut take their next theme; until no theme is over its limit. Cuts only
    tighten, so the rounds end. What the driver sees is one cut per theme, and the
    number of themes is checked.
    """
    level, *keys = priority
    ready = durable(
        images.where(
            F.exists("chart_type", lambda t: t.isin(*keep_charts)) & (F.size("content_theme") > 0)
        ).withColumn("_rank", F.struct((-F.col(level)).alias("l"), *keys))
    )
    rank_type = ready.schema["_rank"].dataType
    cuts: dict[int, tuple] = {}

    def choose():
        # a theme is open to an image unless its cut lies before the image
        if not cuts:
            return ready.withColumn("theme", F.get("content_theme", F.lit(0)))
        table = F.create_map(
            *[
                x
                for theme, cut in cuts.items()
                for x in (F.lit(theme), F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(cut, rank_type.fields)]))
            ]
        )
        closed = F.array(*[F.lit(t) for t in cuts])
        open_ones = F.filter(
            "content_theme",
            lambda t: ~F.array_contains(closed, t) | (F.col("_rank") <= F.try_element_at(table, t)),
        )
        return ready.withColumn("theme", F.get(open_ones, F.lit(0)))

    while True:
        chosen = choose().where("theme IS NOT NULL")
        # The limit-th best taker of each theme: per-group top-k, pruned before the shuffle.
        over = (
            chosen.select("theme", "_rank")
            .withColumn("_k", F.row_number().over(W.partitionBy("theme").orderBy("_rank")))
            .where(F.col("_k") <= limit + 1)
            .groupBy("theme")
            .agg(
                F.max("_k").alias("n"),
                F.max(F.when(F.col("_k") <= limit, F.col("_rank"))).alias("cut"),
            )
            .where(F.col("n") > limit)
            .limit(max_themes + 1)
            .collect()
        )
        if len(over) > max_themes:
            raise ValueError(f"more than {max_themes} themes; the taxonomy is expected to be small")
        if not over:
            return chosen.drop("_rank")
        for r in over:
            cuts[r["theme"]] = tuple(r["cut"])


def sampler_summary(screen: DataFrame, top: DataFrame, kept: DataFrame) -> DataFrame:
    """Totals at each step of the funnel, one row."""

    def tag(df, step, **cols):
        values = {"compliance_level": F.lit(None).cast("int"), "complexity_level": F.lit(None).cast("int")}
        values.update(cols)
        return df.select(F.lit(step).alias("step"), *[v.cast("int").alias(k) for k, v in values.items()])

    rows = tag(
        screen, "all", compliance_level=F.col("compliance_level"), complexity_level=F.col("complexity_level")
    ).unionByName(tag(top, "top")).unionByName(tag(kept, "kept"))
    good = F.col("compliance_level").isin(*COMPLIANCE_LEVELS) & F.col("complexity_level").isNotNull()
    return rows.agg(
        F.count_if(F.col("step") == "all").alias("total_files_processed"),
        F.count("compliance_level").alias("compliance_levels_count"),
        F.count("complexity_level").alias("complexity_levels_count"),
        F.count_if(good).alias("filtered_records_count"),
        F.count_if(F.col("step") == "top").alias("output_records_count"),
        F.count_if(F.col("step") == "kept").alias("filtered_output_records_count"),
    )
