"""Personal data: pattern spans, and terms that reveal a protected value by corpus co-occurrence.

Base spans (email, ip, card, phone) come from regular expressions over whole texts: ``regexp_extract_all`` gives
the matches, ``split`` the pieces between them, and running lengths their places in code points. The patterns are
written so that no match is tried twice from within one run of characters; arrays are bound before any lambda, built
in blocks and looked up by halving, so that a text's time grows little faster than its length.

Method: every value found is a protected entity, however rare. For a term t and an entity e,
disclosure(t; e) = log(N c(t,e) / (d(t) d(e))) / log(N / d(e)), the pointwise mutual information over the
entity's whole information, where d counts different texts, c texts with both, and N all texts. Terms (words, A-Z
lower-cased) with a disclosure of ``threshold`` or more are spans of kind ``term`` in every text that holds the entity; for a value of
one text only, these are the words that hardly any other text has. Counts cover the whole corpus: candidate terms
come from the texts that hold entities, and d(t) from all texts, joined on the term. DataFrame operations only.

Defined cases: a null or empty text has no spans; copies count once in the statistics and are marked each;
overlapping spans of different kinds all stay, and are replaced as one by the first's tag; an empty table gives
an empty table; extra columns are ignored (``sanitised`` keeps them).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

KINDS = ("email", "ip", "card", "phone", "term")
#: A run is tried from its first character, or from where the last match ended, only.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests without which a pattern cannot match.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]++"
THRESHOLD = 0.95
#: Elements that an array is built from at a time, and characters of a text.
STEP, BLOCK = 256, 2048
_SPAN = "array<struct<start:int,kind:int,stop:int,value:string>>"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _let(value: Column, body) -> Column:
    """``body(value)``, with ``value`` computed once: a column named inside a lambda may be put there by the optimiser and computed for every element."""
    return F.transform(F.array(value), body)[0]


_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def _luhn(c: Column) -> Column:
    def total(d: Column) -> Column:
        digit = lambda k: F.substr(d, k + 1, F.lit(1)).cast("int")
        return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), lambda acc, k: acc + F.when(k % 2 == 0, digit(k)).otherwise(F.array(*map(F.lit, _DOUBLED))[digit(k)]))

    return _let(F.reverse(_digits(c)), total) % 10 == 0


def _valid(kind: str, v: Column) -> Column:
    if kind == "ip":
        small = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.nullif(F.substr(F.ltrim(p, F.lit("0")), F.lit(1), F.lit(3)), F.lit("")), F.lit("0")).cast("int") <= 255)
        return F.forall(F.split(v, r"\."), small)
    if kind == "card":
        n = F.length(_digits(v))
        return F.when((n >= 14) & (n <= 19), _luhn(v)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(v)).between(10, 15)
    return F.lit(True)


def _running(lengths: Column) -> Column:
    """Sum of all elements before each one. An array grows by copying, so it is built in blocks of ``STEP``."""
    empty = F.array().cast("array<int>")

    def sums(start: Column, values: Column) -> Column:
        first = F.struct(start.alias("at"), empty.alias("out"))
        return F.aggregate(values, first, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def by_block(blocks: Column) -> Column:
        heads = sums(F.lit(0), F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda acc, x: acc + x)))
        return F.flatten(F.zip_with(blocks, heads, lambda b, at: sums(at, b)))

    def cut(x: Column) -> Column:
        return _let(F.transform(F.sequence(F.lit(0), F.size(x) - 1, F.lit(STEP)), lambda i: F.slice(x, i + 1, F.lit(STEP))), by_block)

    return _let(lengths, lambda x: F.when(F.size(x) > 0, cut(x)).otherwise(empty))


def _places(found: Column, pieces: Column, kind: int, keep) -> Column:
    """Spans of the matches that ``keep`` accepts, from matches and the pieces around them."""

    def located(both: Column) -> Column:
        before = _running(F.transform(both, lambda x: x["gap"] + F.length(x["value"])))

        def span(x: Column, at: Column) -> Column:
            start = at + x["gap"]
            return F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(x["value"])).alias("stop"), x["value"].alias("value"))

        return F.filter(F.zip_with(both, before, span), lambda s: keep(s["value"]))

    # the piece after the last match has no value
    both = F.filter(F.zip_with(found, pieces, lambda v, p: F.struct(F.length(p).alias("gap"), v.alias("value"))), lambda x: x["value"].isNotNull())
    return _let(both, located)


def _first(values: Column, turns: Column, reached) -> Column:
    """Index of the first element that ``reached`` holds for, by halving; it holds for all after it. ``turns``: see ``_turns``."""

    def step(acc: Column, _: Column) -> Column:
        mid = F.shiftright(acc["lo"] + acc["hi"], 1)
        left = (acc["lo"] < acc["hi"]) & reached(F.get(values, mid))
        return F.struct(F.when(left | (acc["lo"] >= acc["hi"]), acc["lo"]).otherwise(mid + 1).alias("lo"), F.when(left, mid).otherwise(acc["hi"]).alias("hi"))

    return F.aggregate(turns, F.struct(F.lit(0).alias("lo"), F.size(values).alias("hi")), step, lambda acc: acc["lo"])


def _turns(values: Column) -> Column:
    """As many elements as it takes to halve ``values`` down to one."""
    return F.sequence(F.lit(0), F.ceil(F.log2(F.size(values) + 1.0)).cast("int"))


def with_base_spans(docs: DataFrame, text: str) -> DataFrame:
    """Adds ``base``: all spans of the four kinds, by start, then kind. ``text`` is a column without nulls."""
    none = F.array().cast(_SPAN)
    out = docs.withColumns({f"_{k}": F.when(F.contains(text, F.lit(NEEDS[k])) if NEEDS[k] else F.lit(True), F.regexp_extract_all(text, F.lit(p), F.lit(0))) for k, p in PATTERNS.items()})
    # long numbers are rare, so the text is cut up only where some match may pass
    likely = {"card": F.exists(F.coalesce("_card", F.array().cast("array<string>")), lambda v: F.length(v) >= 14)}
    spans = {f"_{k}": F.when((F.size(f"_{k}") > 0) & likely.get(k, F.lit(True)), _places(F.col(f"_{k}"), F.split(text, p, -1), i, lambda v, k=k: _valid(k, v))).otherwise(none) for i, (k, p) in enumerate(PATTERNS.items())}
    return out.withColumns(spans).withColumn("base", F.sort_array(F.concat(*spans))).drop(*spans)


def joined(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.array(*map(F.lit, KINDS))[s["kind"]], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _lowered(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _entity(span: Column) -> Column:
    """The protected value: kind and the value without its punctuation or capitals."""
    plain = F.when(span["kind"] >= 2, _digits(span["value"])).otherwise(_lowered(span["value"]))
    return F.concat_ws(":", span["kind"].cast("string"), plain)


def _terms(text: Column) -> Column:
    return F.filter(F.array_distinct(F.split(_lowered(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")), lambda w: w != "")


def _disclosing(texts: DataFrame, total: int, found: DataFrame, scratch: Scratch, threshold: float) -> DataFrame | None:
    """(text_id, places) of the texts that hold an entity with disclosing terms. ``texts``: key, text of all documents;
    ``total``: their different texts; ``found``: text_id, text, base of the different texts with spans.

    A term of one text only has c = 1 with each entity of its text, and an entity of one text only c = 1 with each word
    of it, so neither needs pairs. The others are paired within a text, entities that share all their texts as one.
    """
    values = found.select("text_id", F.explode(F.array_distinct(F.transform("base", _entity))).alias("entity"))
    places = [F.bit_xor(F.xxhash64("text_id", F.lit(k))).alias(f"s{k}") for k in (0, 1)]
    entities = values.groupBy("entity").agg(F.count("*").alias("de"), *places)
    holders = F.when(F.col("de") > 1, F.struct("de", "s0", "s1")).alias("holders")  # of entities with the same texts
    held = scratch.table(values.join(entities, "entity").select("text_id", "de", holders).distinct(), "held")
    held = held.where(F.col("de") < total)
    widest = held.agg(F.max("de")).first()[0]
    if widest is None:
        return None
    low = _lowered(F.col("text"))
    words = _places(F.regexp_extract_all(low, F.lit(WORD), F.lit(0)), F.split(low, WORD, -1), 4, lambda v: F.lit(True))
    words = found.select("text_id", F.explode(words).alias("s")).select("text_id", F.col("s.start").alias("start"), F.col("s.value").alias("term"))
    inside = found.select("text_id", F.explode(F.array_distinct(F.flatten(F.transform("base", lambda s: _terms(s["value"]))))).alias("term"))
    # one of each text first: then its words are counted before the shuffle, without the keys
    once = texts.dropDuplicates(["key"])
    dt = once.select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("dt"))
    log_n = math.log(total)
    # c is at most d(t) and d(e), so no more frequent term can reach the threshold with any entity
    bound = math.exp((1 - threshold) * log_n + threshold * math.log(widest)) * (1 + 1e-6)
    known = words.join(dt.where(F.col("dt") <= max(1.0, bound)), "term").groupBy("text_id", "term").agg(F.first("dt").alias("dt"), F.collect_list("start").alias("starts"))
    known = scratch.table(known.join(inside, ["text_id", "term"], "left_anti"), "known")

    def strong(c: Column, de: Column) -> Column:
        return F.log(c * float(total) / (F.col("dt") * de)) >= threshold * F.log(float(total) / de)

    least = held.groupBy("text_id").agg(F.min("de").alias("de"))
    by_itself = known.join(least, "text_id").where((F.col("dt") == 1) | ((F.col("de") == 1) & strong(F.lit(1), F.lit(1)))).select("text_id", "term", "starts")
    may = F.log(F.col("dt").cast("double")) <= (1 - threshold) * log_n + threshold * F.log("de") + 1e-6
    several = held.where(F.col("holders").isNotNull()).join(known.where("dt > 1"), "text_id").where(may)
    several = scratch.table(several.select("text_id", "holders", "de", "term", "dt", "starts"), "several")
    pairs = several.groupBy("holders", "term").agg(F.first("de").alias("de"), F.first("dt").alias("dt"), F.count("*").alias("c"))
    # joined back to the texts that hold both, so that a text's terms are words of its own
    shared = several.select("text_id", "holders", "term", "starts").join(pairs.where(strong(F.col("c"), F.col("de"))).select("holders", "term"), ["holders", "term"])
    out = by_itself.unionByName(shared.select("text_id", "term", "starts")).groupBy("text_id", "term").agg(F.first("starts").alias("starts"))
    place = F.transform("starts", lambda at: F.struct(at.alias("start"), F.lit(4).alias("kind"), (at + F.length("term")).alias("stop"), F.col("term").alias("value")))
    return out.groupBy("text_id").agg(F.sort_array(F.flatten(F.collect_list(place))).alias("places"))


def _is(kind: int):
    return lambda s: s["kind"] == kind


def _field(name: str):
    return lambda s: s[name]


def _free(holders: DataFrame) -> DataFrame:
    """(key, extra) for (key, base, places): the places that meet no base span, looked up by halving."""
    # spans of one kind do not overlap, so both their starts and their stops ascend
    own = [F.filter("base", _is(k)) for k in range(4)]

    def free(t: Column) -> Column:
        def hit(s: Column, k: int) -> Column:
            b = t[f"b{k}"]
            return (F.size(b["kind"]) > 0) & F.coalesce(F.get(b["start"], _first(b["stop"], t[f"t{k}"], lambda x: x > s["start"])) < s["stop"], F.lit(False))

        return F.filter(t["places"], lambda s: ~(hit(s, 0) | hit(s, 1) | hit(s, 2) | hit(s, 3)))

    lists = [F.struct(*(F.transform(o, _field(f)).alias(f) for f in ("kind", "start", "stop"))).alias(f"b{k}") for k, o in enumerate(own)]
    extra = _let(F.struct("places", *lists, *(_turns(o).alias(f"t{k}") for k, o in enumerate(own))), free)
    return holders.select("key", extra.alias("extra"))


def _prepared(docs: DataFrame, text_col: str, carried: tuple[str, ...], scratch: Scratch, threshold: float) -> tuple[DataFrame, DataFrame | None]:
    """(carried columns as c0, c1, ..., key and base of every document; key and term spans of the texts that have some)."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    df = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carried)), text.alias("text"))
    df = df.withColumn("key", _key(F.col("text")))
    marked = with_base_spans(df, "text")
    # texts without spans, most of them, are not written
    marked = scratch.table(marked.withColumn("text", F.when(F.size("base") > 0, F.col("text"))), "base")
    found = marked.where("text IS NOT NULL").select("key", "text", "base").dropDuplicates(["key"])
    # spread by count: the work of a text is far more than its bytes suggest, by which adaptive execution would pack texts
    found = found.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key")
    found = scratch.table(found.withColumn("text_id", F.monotonically_increasing_id()), "found")  # written, so it stays
    places = _disclosing(df.select("key", "text"), marked.select("key").distinct().count(), found, scratch, threshold)
    if places is None:
        return marked.drop("text"), None
    extra = scratch.table(_free(places.join(found.select("text_id", "key", "base"), "text_id")), "extra")
    return marked.drop("text"), extra.where(F.size("extra") > 0)


def _key(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _all_spans() -> Column:
    return F.when(F.col("extra").isNull(), F.col("base")).otherwise(F.sort_array(F.concat("base", "extra")))


def spans(docs: DataFrame, text_col: str = "text", carried: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """``carried`` columns, ``base`` and ``spans`` (base and term spans, by start, then kind, then end) of every document."""
    marked, extra = _prepared(docs, text_col, carried, Scratch(docs.sparkSession), threshold)
    none = F.lit(None).cast(_SPAN).alias("extra")
    if extra is None:
        out = marked.select("*", none)
    else:
        # only texts with base spans have terms; the others, however many copies of a text there are, meet no join
        some = F.size("base") > 0
        out = marked.where(some).join(extra, "key", "left").unionByName(marked.where(~some).select("*", none))
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(carried)), "base", _all_spans().alias("spans"))


def replaced(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping spans, replaced by its first kind in angle brackets.

    The text is cut into blocks of ``BLOCK`` characters first and spans are taken ``STEP`` at a time, so that no step
    reads or copies all that lies before it.
    """

    def part(blocks: Column, a: Column, z: Column) -> Column:
        """Characters a to z - 1."""
        at = lambda p: F.floor(p / BLOCK).cast("int")
        head = F.substr(blocks[at(a)], a % BLOCK + 1, z - a)  # to the end of the block at most
        rest = F.concat(F.array_join(F.slice(blocks, at(a) + 2, at(z) - at(a) - 1), ""), F.coalesce(F.substr(F.get(blocks, at(z)), F.lit(1), z % BLOCK), F.lit("")))
        return F.when(z <= a, "").when(at(a) == at(z), head).otherwise(F.concat(head, rest))

    def put(t: Column) -> Column:
        def one(acc: Column, s: Column) -> Column:
            tag = F.concat(F.lit("<"), F.upper(F.array(*map(F.lit, KINDS))[s["kind"]]), F.lit(">"))
            more = F.concat(acc["out"], F.array(part(t["blocks"], acc["at"], s["start"]), tag))
            return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.when(s["start"] >= acc["at"], more).otherwise(acc["out"]).alias("out"))

        def many(acc: Column, i: Column) -> Column:
            inner = F.aggregate(F.slice(t["spans"], i + 1, F.lit(STEP)), F.struct(acc["at"].alias("at"), none.alias("out")), one)
            return _let(inner, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], F.array(F.array_join(x["out"], ""))).alias("out")))

        none = F.array().cast("array<string>")
        start = F.struct(F.lit(0).alias("at"), none.alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.size(t["spans"]) - 1, F.lit(STEP)), start, many, lambda acc: F.concat(F.array_join(acc["out"], ""), part(t["blocks"], acc["at"], t["n"])))

    bound = F.struct(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)).alias("blocks"), spans.alias("spans"), F.length(text).alias("n"))
    return F.when(F.size(spans) > 0, _let(bound, put)).otherwise(text)


def sanitised(docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs``, with spans in ``text_col`` replaced; an ``n_chars`` column follows where a text changed."""
    _, extra = _prepared(docs, text_col, (), Scratch(docs.sparkSession), threshold)
    names, types = docs.columns, [t for _, t in docs.dtypes]
    at = names.index(text_col)
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    # base spans are found anew rather than joined, so that texts without any, most of them, are not shuffled
    marked = with_base_spans(plain.withColumn("text", F.coalesce(F.col(f"c{at}").cast("string"), F.lit(""))), "text")
    some, none = marked.where(F.size("base") > 0), marked.where(F.size("base") == 0)
    if extra is None:
        some = some.withColumn("extra", F.lit(None).cast(_SPAN))
    else:
        some = some.withColumn("key", _key(F.col("text"))).join(extra, "key", "left")
    some = some.withColumn("changed", replaced(F.col("text"), _all_spans()))
    columns = [F.col(f"c{i}") for i in range(len(names))]
    new = list(columns)
    new[at] = F.col("changed").cast(types[at])
    if "n_chars" in names and text_col != "n_chars":
        k = names.index("n_chars")
        new[k] = F.length("changed").cast(types[k])
    return some.select(*(c.alias(f"c{i}") for i, c in enumerate(new))).union(none.select(*columns)).toDF(*names)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    out = spans(docs, text_col, (id_col,))

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return out.select(id_col, *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
