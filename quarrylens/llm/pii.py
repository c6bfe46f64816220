"""Personal data: fixed shapes, and identifiers found by bootstrapped contextual extraction. DataFrame functions only.

Base spans are e-mail addresses, IPv4 addresses, card numbers and phone numbers. They are seeds of the second
step, and so are identifier-like tokens that a text assigns to a name of credentials (``SEEDS``). What stands before a
span is a lexical pattern: its two words, and its last word with the signs after it if there are any but white space
(``token = "``). What follows a pattern is an instance, and the graph of
patterns and instances covers the surroundings of all identifier-like tokens of the corpus, with ordinary
words as instances too. Where fewer than two words are there, or the context begins within reach, marks stand
for the words that lack: one for the start of the text, one for any other place. In each round a pattern's confidence is the share of known instances among all that
follow it (unknown tokens count half); an unknown token whose confident patterns add up to a high score becomes known, and supports
further patterns in the next round, until a round finds none. Seeds and found tokens are spans of the kind ``id``.

Rows: a null text has no spans; rows are told apart by doc_id (null as a value) and text, so repeated rows
have the same spans; ties cannot arise, since spans are ordered by kind and place; an empty table gives an
empty result; other columns pass through ``redacted``.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
FOUND = "id"
#: The contract's shapes, written so that the JVM's matcher neither recurses nor rescans a run of signs.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: An identifier-like token: eight signs or more, two of them digits.
TOKEN = r"(?<![\p{L}0-9_-])(?=[A-Za-z0-9_-]*[0-9][A-Za-z_-]*[0-9])[A-Za-z0-9_-]{8,}+(?![\p{L}])"
#: Code points before a span that give its pattern; patterns need so many known instances, and this confidence.
BEFORE, SUPPORT, CONFIDENCE = 60, 3, 0.8
#: What stands for words before the start of a text, and before other contexts that are too short.
START, BREAK = "^", "~"
#: Seeds: a name of credentials, an equals sign or colon, and the token.
SEEDS = r"(?i)(?:^|[^\p{L}0-9])(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|auth|bearer|credentials?|ssn|iban|passport)[\"']?\s*[:=]\s*[\"']?$"
#: Numbers summed together in prefix sums.
STRIDE = 256

SPAN = "struct<start:bigint,end:bigint,text:string,before:string>"


def _guard(kind: str, text: Column) -> Column:
    """A cheap test that no text with a match fails."""
    digit = text.rlike("[0-9]")
    return {
        "email": F.contains(text, F.lit("@")),
        "ip": digit & text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
        "card": digit & text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"),
        "phone": F.contains(text, F.lit("+")) & text.rlike(r"\+[0-9]"),
        FOUND: digit,
    }[kind]


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x)


def _spans(gaps: Column, found: Column) -> Column:
    """Each match with its place, from the matches and the texts between them; linear but for blocks of sums."""
    sizes = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: (F.length(g) + F.length(m)).cast("long"))

    def let(value: Column, body) -> Column:
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def with_sizes(s: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), ((F.size(s) - 1) / STRIDE).cast("int")), lambda b: _sum(F.slice(s, b * STRIDE + 1, F.lit(STRIDE))))

        def with_blocks(own: Column) -> Column:
            starts = F.transform(own, lambda _, b: _sum(F.slice(own, F.lit(1), b)))

            def each(before: Column) -> Column:
                def span(m: Column, i: Column) -> Column:
                    block = (i / STRIDE).cast("int")
                    gap = F.get(gaps, i)
                    start = F.get(before, block) + _sum(F.slice(s, block * STRIDE + 1, i % STRIDE)) + F.length(gap)
                    return F.struct(start.cast("long").alias("start"), (start + F.length(m)).cast("long").alias("end"), m.alias("text"), F.right(gap, F.lit(BEFORE)).alias("before"))

                return F.transform(found, span)

            return let(starts, each)

        return let(blocks, with_blocks)

    return F.when(F.size(found) > 0, let(sizes, with_sizes)).otherwise(F.array().cast(f"array<{SPAN}>"))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _valid(kind: str, text: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(text, r"\."), lambda part: (F.length(F.regexp_replace(part, "^0+", "")) <= 3) & (F.substring(F.concat(F.lit("0"), F.regexp_replace(part, "^0+", "")), 1, 4).cast("int") <= 255))
    if kind == "phone":
        return F.length(_digits(text)).between(8, 15)
    if kind == "card":
        turned = F.transform(F.split(F.reverse(_digits(text)), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
        return F.length(_digits(text)).between(16, 19) & F.when(F.length(_digits(text)).between(16, 19), F.aggregate(turned, F.lit(0), lambda a, d: a + d) % 10 == 0).otherwise(False)
    return F.lit(True)


def _matches(rows: DataFrame, kind: str, pattern: str, text: str) -> DataFrame:
    """Adds the column ``kind``: the valid matches' spans."""
    given = F.col(text)
    rows = rows.withColumn("__found", F.when(_guard(kind, given), F.regexp_extract_all(given, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("__gaps", F.when(F.size("__found") > 0, F.split(given, pattern, -1)).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("__spans", _spans(F.col("__gaps"), F.col("__found")))
    kept = F.when(F.size("__spans") > 0, F.filter("__spans", lambda s: _valid(kind, s["text"]))).otherwise(F.col("__spans"))
    return rows.withColumn(kind, kept).drop("__found", "__gaps", "__spans")


def base_spans(rows: DataFrame, text: str) -> DataFrame:
    """Adds an array of spans for each of KINDS, and one of the identifier-like tokens that touch none of them."""
    for kind in KINDS:
        rows = _matches(rows, kind, PATTERNS[kind], text)
    rows = _matches(rows, FOUND, TOKEN, text)
    all_ = F.concat(*KINDS)
    return rows.withColumn(FOUND, F.when(F.size(FOUND) > 0, F.filter(FOUND, lambda t: ~F.exists(all_, lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))).otherwise(F.col(FOUND)))


def graph(found: DataFrame) -> DataFrame:
    """(pattern, instance, token, known, seed): what follows each pattern before a span or token, once; seed: a token that is known from the start."""

    def spot(s: Column, seed: Column, known: Column) -> Column:
        return F.struct(s["start"].alias("start"), s["text"].alias("text"), s["before"].alias("before"), seed.alias("seed"), known.alias("known"))

    seeds = F.transform(F.concat(*KINDS), lambda s: spot(s, F.lit(False), F.lit(True)))
    tokens = F.transform(FOUND, lambda s: spot(s, s["before"].rlike(SEEDS), s["before"].rlike(SEEDS)))
    spots = found.where(F.size(F.concat(*KINDS, FOUND)) > 0).select(F.explode(F.concat(seeds, tokens)).alias("spot"))
    # words, each with the signs that follow it
    pieces = spots.select("spot", F.regexp_extract_all(F.lower("spot.before"), F.lit(r"\p{L}+[^\p{L}]*"), F.lit(0)).alias("pieces"))
    size = F.length("spot.before")
    mark = F.when(F.col("spot.start") == size, START).otherwise(BREAK)
    padded = F.when((size < BEFORE) | (F.size("pieces") < 2), F.concat(F.array(mark, mark), "pieces")).otherwise(F.col("pieces"))
    pieces = pieces.select("spot", padded.alias("pieces")).withColumn("words", F.transform("pieces", lambda x: F.regexp_extract(x, r"^(?:\p{L}+|.)", 0)))
    last = F.size("words") - 1

    def follows(pattern: Column, i: Column) -> Column:
        end = i == last
        return F.struct(
            pattern.alias("pattern"),
            F.when(end, F.col("spot.text")).otherwise(F.get("words", i + 1)).alias("instance"),
            end.alias("token"),
            (end & F.col("spot.known")).alias("known"),
            (end & F.col("spot.seed")).alias("seed"),
        )

    words = F.transform(F.sequence(F.lit(1), last), lambda i: follows(F.concat_ws(" ", F.get("words", i - 1), F.get("words", i)), i))
    signs = F.filter(F.transform(F.sequence(F.lit(0), last), lambda i: follows(F.concat(F.get("pieces", i), F.lit("|")), i)), lambda e: e["pattern"].rlike(r"^\p{L}+\s*[^\p{L}\s].*\|$"))
    edges = pieces.select(F.explode(F.concat(words, signs)).alias("e")).select("e.*")
    return edges.groupBy("pattern", "instance", "token").agg(F.max("known").alias("known"), F.max("seed").alias("seed"))


def discovered(edges: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(instance): the tokens that are seeds or became known."""
    state = common.cut(edges.where("token").groupBy("instance").agg(F.max("known").alias("known"), F.max("seed").alias("seed")).select("instance", "known", F.when(F.col("seed"), 1).otherwise(0).alias("round")))
    links = common.stored(edges.select("pattern", "instance", "token"), "graph")
    for k in count(2):
        known = state.where("known").select("instance", F.lit(True).alias("token"), F.lit(1).alias("one"))
        seen = links.join(known, ["instance", "token"], "left")
        # an unknown token speaks half against a pattern, an ordinary word fully
        against = F.when(F.col("one").isNotNull(), 0.0).when(F.col("token"), 0.5).otherwise(1.0)
        scores = seen.groupBy("pattern").agg(F.count("one").alias("known"), (F.count("one") + F.sum(against)).alias("all")).where((F.col("known") >= support) & (F.col("known") >= F.col("all") * confidence))
        trusted = scores.select("pattern", (F.col("known") / (F.col("all") + 1)).alias("trust"))
        # log of the chance that all of an instance's patterns are wrong
        voted = links.where("token").join(trusted, "pattern").groupBy("instance").agg(F.sum(F.log(1 - F.col("trust"))).alias("doubt"))
        new = voted.where(F.col("doubt") <= F.log(F.lit(1 - confidence * support / (support + 1)))).select("instance", F.lit(True).alias("new"))
        fresh = ~F.col("known") & F.coalesce("new", F.lit(False))
        after = common.cut(state.join(new, "instance", "left").select("instance", (F.col("known") | fresh).alias("known"), F.when(fresh, k).otherwise(F.col("round")).alias("round")))
        grown = not after.where(F.col("round") == k).isEmpty()
        state = after
        if not grown:
            break
    return state.where(F.col("known") & (F.col("round") > 0)).select("instance")


def row_key(doc_id: str, text: str) -> Column:
    """Tells rows apart; equal rows have equal spans."""
    return F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("-")), F.xxhash64(text), F.crc32(F.col(text).cast("binary")), F.length(text))


def personal_data(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, key, arrays of spans for each of KINDS, id: array of the discovered spans) for every row."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), common.text_of(text).alias("__text"))
    found = common.stored(base_spans(rows.withColumn("key", row_key("doc_id", "__text")), "__text").drop("__text"), "spans")
    names = discovered(graph(found))
    spots = found.where(F.size(FOUND) > 0).select("key", F.explode(FOUND).alias("s")).select("key", "s", F.col("s.text").alias("instance"))
    by_row = spots.join(names, "instance").groupBy("key").agg(F.array_sort(F.collect_set("s")).alias("__new"))
    return found.join(by_row, "key", "left").withColumn(FOUND, F.coalesce("__new", F.array().cast(f"array<{SPAN}>"))).drop("__new")


def digest(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of the spans of these kinds, in order, joined by commas."""

    def named(kind: str) -> Column:
        return F.transform(F.col(kind), lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))

    return F.array_join(F.concat(*map(named, kinds)), ",")


def merged_spans(spans: DataFrame) -> DataFrame:
    """(key, marks: array of start, end and kind): the spans of all kinds in order, those that overlap as one of the first one's kind."""

    def ranked(rank: int, kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind.upper()).alias("kind")))

    each = F.concat(*(ranked(n, kind) for n, kind in enumerate((*KINDS, FOUND))))
    flat = spans.dropDuplicates(["key"]).select("key", F.explode(each).alias("s")).select("key", "s.*")
    order = Window.partitionBy("key").orderBy("start", "rank")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    heads = flat.withColumn("head", F.coalesce(F.col("start") >= reach, F.lit(True)).cast("int"))
    numbered = heads.withColumn("group", F.sum("head").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    whole = numbered.groupBy("key", "group").agg(F.min(F.struct("start", "rank", "kind")).alias("first"), F.max("end").alias("end"))
    return whole.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("first.start", "end", "first.kind"))).alias("marks"))


def _marked(text: Column, marks: Column) -> Column:
    """The text with every mark's place replaced; marks are cut from parts of STRIDE of them, so that no cut looks at a long text."""

    def after(k: Column) -> Column:
        return F.coalesce(F.get(marks, k - 1)["end"], F.lit(0).cast("long"))

    def cut(of: Column, start: Column, end: Column) -> Column:
        return F.substring(of, (start + 1).cast("int"), (end - start).cast("int"))

    def part(block: Column) -> Column:
        first, own = block * STRIDE, F.slice(marks, block * STRIDE + 1, F.lit(STRIDE))

        def pieces(of: Column) -> Column:
            base = after(first)
            return F.array_join(F.transform(own, lambda m, k: F.concat(cut(of, after(first + k) - base, m["start"] - base), F.lit("<"), m["kind"], F.lit(">"))), "")

        return F.get(F.transform(F.array(cut(text, after(first), F.element_at(own, -1)["end"])), pieces), F.lit(0))

    parts = F.transform(F.sequence(F.lit(0), ((F.size(marks) - 1) / STRIDE).cast("int")), part)
    return F.concat(F.array_join(parts, ""), cut(text, F.element_at(marks, -1)["end"], F.length(text)))


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind's name in angle brackets; spans that overlap by the first one's."""
    wide = common.boxed(docs, "doc_id", "text").select(common.ROW, "doc_id", common.text_of("text").alias("__text")).select("*", row_key("doc_id", "__text").alias("__key"))
    spans = personal_data(docs).where(F.size(F.concat(*KINDS, FOUND)) > 0)
    rows = wide.join(merged_spans(spans).select(F.col("key").alias("__key"), F.col("marks").alias("__marks")), "__key", "left")
    rows = rows.withColumn("__text", F.when(F.col("__marks").isNotNull(), _marked(F.col("__text"), F.col("__marks"))))
    touched, old = F.col("__marks").isNotNull(), lambda c: F.col(f"{common.ROW}.{c}")
    changed = {"text": F.when(touched, F.col("__text")).otherwise(old("text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(touched, F.length("__text").cast(docs.schema["n_chars"].dataType)).otherwise(old("n_chars"))
    return common.unboxed(rows, docs.columns, **changed)
