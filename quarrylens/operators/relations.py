"""Joins, set operations and ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def suffixes(name: Column, separator: str = ".") -> Column:
    """All dotted tails of a name, itself first, so that "ends with" becomes an equality."""
    parts = F.split(name, "\\" + separator)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), separator))


def unused(exports: DataFrame, imports: DataFrame, file: str, name: str, star: str = "*") -> DataFrame:
    """Exports that nobody imports by name, of files that nobody imports whole."""
    whole = imports.where(F.col(name) == star).select(file).distinct()
    return exports.join(imports.select(file, name).distinct(), [file, name], "left_anti").join(whole, file, "left_anti")


def first_candidate(rows: DataFrame, keys: list[str], candidates: list[Column] | Column, targets: DataFrame, target: str) -> DataFrame:
    """keys, target, rank: of each row's candidate values the first that is in ``targets``; none: no row."""
    ranked = rows.select(*keys, F.posexplode(F.array(*candidates) if isinstance(candidates, list) else candidates).alias("rank", target)).where(F.col(target).isNotNull())
    found = ranked.join(targets.select(target).distinct(), target, "left_semi")
    return found.groupBy(*keys).agg(F.min(F.struct("rank", target)).alias("m")).select(*keys, F.col(f"m.{target}").alias(target), F.col("m.rank").alias("rank"))


def union_of(parts: dict[str, DataFrame], kind: str = "kind") -> DataFrame:
    return reduce(DataFrame.unionByName, (df.withColumn(kind, F.lit(name)) for name, df in parts.items()))


#: Lengths of the pieces by which short passages are looked up, longest last.
PIECES = (1, 2, 3, 6, 12, 24)


def _by_pieces(texts: DataFrame, short: DataFrame, widths: list[int]) -> DataFrame:
    """(__k, __p): texts (__k, __text) with a word that contains the word ``__w`` of a passage (__p, __w).

    A passage is looked up by the piece of its word, of the greatest width that fits, that fewest passages have, so a beginning that
    all share brings nothing together; pieces are made of distinct words, not of every text.
    """
    fits = F.greatest(*(F.when(F.length("__w") >= w, F.lit(w)) for w in widths)) if len(widths) > 1 else F.lit(widths[0])
    pieces = F.transform(F.sequence(F.lit(1), F.length("__w") - F.col("__width") + 1), lambda i: F.substring("__w", i, F.col("__width")))
    spread = short.select("__w").distinct().withColumn("__width", fits).select("__w", F.explode(F.array_distinct(pieces)).alias("__piece"))
    often = spread.groupBy("__piece").agg(F.count("*").alias("__often"))
    chosen = spread.join(often.hint("merge"), "__piece").groupBy("__w").agg(F.min(F.struct("__often", "__piece")).alias("m")).select("__w", F.col("m.__piece").alias("__piece"))
    words = texts.select("__k", F.explode(F.array_distinct(F.split("__text", " ", -1))).alias("__word")).where("__word <> ''")
    held = F.flatten(F.array(*(F.regexp_extract_all("__word", F.lit(f"(?=([^ ]{{{w}}}))"), F.lit(1)) for w in widths)))
    met = words.select("__word").distinct().select("__word", F.explode(F.array_distinct(held)).alias("__piece")).join(chosen.hint("merge"), "__piece").where(F.contains("__word", F.col("__w"))).select("__word", "__w")
    # words meet their passages before they meet the texts, so what goes through the texts' join is done
    holds = met.join(short.hint("merge"), "__w").select("__word", "__p").distinct()
    return words.join(holds.hint("merge"), "__word").select("__k", "__p")


def containing(texts: DataFrame, key: str, passages: DataFrame, passage_key: str, text: str = "text", passage: str = "text") -> DataFrame:
    """(key, passage_key): which texts contain which passages.

    All words of a passage but its first and last stand whole in a text that contains it, so the second to fifth
    (of shorter ones the second) are joined first and the rest is checked; the longest word of passages of one or two words
    lies in one word of the text, and is looked up there by a rare piece of it. No passage is compared with all texts, but for those of
    spaces only.
    """
    given = passages.select(F.col(passage_key).alias("__p"), F.col(passage).alias("__passage")).where(F.length("__passage") > 0)
    size = F.size(F.split("__passage", " ", -1))
    own = texts.select(F.col(key).alias("__k"), F.col(text).alias("__text")).where(F.col("__text").isNotNull())
    tokens = F.col("__tokens")

    def runs(width: int) -> Column:
        return F.when(F.size(tokens) >= width, F.transform(F.sequence(F.lit(1), F.size(tokens) - (width - 1)), lambda i: F.array_join(F.slice(tokens, i, width), " "))).otherwise(F.array().cast("array<string>"))

    words = F.split("__passage", " ", -1)
    longest = F.array_max(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))
    kinds = [(size >= 6, F.array_join(F.slice(words, 2, 4), " "), runs(4)), (size.between(3, 5) & (F.get(words, F.lit(1)) != ""), F.get(words, F.lit(1)), tokens)]
    rest = ~kinds[0][0] & ~kinds[1][0]
    kinds += [(rest & (longest["n"] == 0), F.lit(" "), F.when(F.contains("__text", F.lit(" ")), F.array(F.lit(" "))).otherwise(F.array().cast("array<string>")))]
    pieced = [rest & (longest["n"] >= w) & (longest["n"] < above) for w, above in zip(PIECES, (*PIECES[1:], 2**31 - 1), strict=True)]
    several = rest & (longest["n"] > 0) & (size > 1)
    counts = given.agg(*(F.count_if(of).alias(f"n{k}") for k, (of, _, _) in enumerate(kinds)), *(F.count_if(of).alias(f"w{w}") for w, of in zip(PIECES, pieced, strict=True)), F.count_if(several).alias("several")).head()
    found = own.select("__k", F.lit(None).cast(given.schema["__p"].dataType).alias("__p")).limit(0)
    whole = found
    for k, (of, anchor, spread) in enumerate(kinds):
        if counts[f"n{k}"]:  # only keys go through the join of all anchors
            split = own.withColumn("__tokens", F.split("__text", " ", -1)).where(F.size("__tokens") > 0)  # a column of its own, so that texts are split once
            held = split.select("__k", F.explode(F.array_distinct(spread)).alias("__anchor"))
            found = found.union(held.join(given.where(of).select("__p", anchor.alias("__anchor")), "__anchor").select("__k", "__p"))
    widths = [w for w in PIECES if counts[f"w{w}"]]
    if widths:
        short = given.where(rest & (longest["n"] > 0)).select("__p", longest["w"].alias("__w"), (size == 1).alias("__one"))
        # a passage of one word needs no second look
        whole = _by_pieces(own, short.where("__one").select("__p", "__w"), widths)
        if counts["several"]:
            found = found.union(_by_pieces(own, short.where("NOT __one").select("__p", "__w"), widths))
    if not counts["several"] and not any(counts[f"n{k}"] for k in range(len(kinds))):  # no text comes back for nothing
        return whole.select(F.col("__k").alias(key), F.col("__p").alias(passage_key)).distinct()
    # texts come back for the few pairs that are left
    hits = found.distinct().join(own, "__k").join(given, "__p").where(F.contains("__text", F.col("__passage")))
    return hits.select("__k", "__p").union(whole).select(F.col("__k").alias(key), F.col("__p").alias(passage_key)).distinct()


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int, total: str = "total") -> DataFrame:
    """The first n rows of each group with their rank, and the group's true size beside them."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias(total))
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)
    return ranked.join(sizes, keys)


def nearest(rows: DataFrame, anchors: DataFrame, key: str, place: str, anchor: str) -> DataFrame:
    """key, place: of each key's rows the one nearest to its anchor, the lower of two."""
    return rows.join(anchors.select(key, F.col(anchor).alias("__at")), key).where(F.col(place) != F.col("__at")).groupBy(key).agg(F.min(F.struct(F.abs(F.col(place) - F.col("__at")).alias("d"), place)).alias("m")).select(key, F.col(f"m.{place}").alias(place))


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The whole first row of each group; ``order`` ends in something unique."""
    rest = [c for c in df.columns if c not in (*keys, *order)]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("m")).select(*keys, *(F.col(f"m.{c}").alias(c) for c in (*order, *rest)))


def segments(df: DataFrame, key: str, order: str, head: Column) -> DataFrame:
    """key, block, first, last, n: a row with ``head`` starts a block that goes on to the next such row; rows before any are block 0."""
    numbered = df.withColumn("block", F.sum(head.cast("int")).over(Window.partitionBy(key).orderBy(order)))
    return numbered.groupBy(key, "block").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def batches(df: DataFrame, group: str, order: str, size: int) -> DataFrame:
    """Adds batch: rows in order, those of a group together in the order the groups first appear, cut into batches of ``size``.

    Groups' sizes are summed over the small table of groups; rows are numbered inside their group only.
    """
    groups = df.groupBy(group).agg(F.min(order).alias("__first"), F.count("*").alias("__n"))
    before = Window.orderBy("__first", group).rowsBetween(Window.unboundedPreceding, -1)
    placed = groups.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).select(group, "__before")
    own = F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1
    return df.withColumn("__own", own).join(placed, group).withColumn("batch", F.floor((F.col("__before") + F.col("__own")) / size)).drop("__before", "__own")


def replace_partitions(previous: DataFrame, current: DataFrame, producer: str, ran: DataFrame, key: str) -> DataFrame:
    """Rows of producers that ran again are replaced, others stay; where a key is in both, the new row wins."""
    kept = previous.join(ran.select(producer).distinct(), producer, "left_anti").join(current.select(key).distinct(), key, "left_anti")
    return kept.unionByName(current)


def cache_probe(rows: DataFrame, cache: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """Adds hit: whether the cache has the key with this fingerprint; null fingerprints never hit."""
    known = cache.where(F.col(fingerprint).isNotNull() & (F.col(fingerprint) != "")).select(key, fingerprint).distinct().withColumn("__hit", F.lit(True))
    return rows.join(known, [key, fingerprint], "left").withColumn("hit", F.coalesce("__hit", F.lit(False))).drop("__hit")
