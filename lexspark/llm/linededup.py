"""Line dedup: every run of words that stands earlier is found and deleted from the later place.

A *word* is a run of characters between blanks (line ends are blanks); of scripts that are written without blanks, each character is
one.  A *window* is ``min_words`` consecutive words, wherever lines end.  Every window but its first place is deleted; "first" is
the smallest key, within a document the smallest position.  So of any repeated run of at least ``min_words`` words, all but the
first place go, to the word.

Winnowing: of the words in a window at which a gram of ``GRAM`` words begins, the one with the least hash is chosen, and its gram
is the window's fingerprint.  Equal windows have equal fingerprints, so only windows whose fingerprint stands at two places are
compared, by 96-bit hashes; all places but the first are marked, and marked windows that touch are joined to runs.

Everything is a DataFrame operation.  A text's words become an array of hashes; which of them are chosen, and by which windows,
follows from how far to either side no hash is less.  No pairs of documents are made.  Grams and windows meet by one shuffle each, and are compared with their
neighbours in order.  What a sample of texts shows to be frequent does not meet in one task: such grams are known to be repeated,
their windows are first compared among ``SALTS`` parts, and the first ones of the parts with each other; texts with many copies are
read once.  The sample decides where rows go, never what is found.  A place is one number, the sizes of all texts before it in the
order of keys.  Texts that equal the text of a smaller key are deleted whole beforehand.

Defined results: a null text stays null, an empty one empty; documents with a null key stay as they are, and others are not
compared with them; rows that share a key are told apart by their texts (those that share both are cut alike, and not for each
other's sake); a document that only repeats earlier text becomes empty, its row stays; columns of any name are carried along.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import delete_path, fresh, preceding_sum, scratch_path, written
from .wordscan import UNSPACED_RANGES

BLANK = " \t\n\x0b\f\r"
#: Not escaped: Java looks behind by whole characters beyond 16 bits only where the pattern itself holds one.
UNSPACED = "".join(f"{chr(a)}-{chr(b)}" for a, b in UNSPACED_RANGES)
#: Holds them in two ranges, which are quicker to look for.
_ABOUT = f"{chr(UNSPACED_RANGES[0][0])}-\u1fff\u3000-{chr(UNSPACED_RANGES[-1][1])}"
#: Between words; the blanks before a word go with it.
CUT = rf"(?<=\S)(?=[\s{UNSPACED}])|(?<=[{UNSPACED}])(?=\S)"
GRAM = 10
#: Tasks over which the copies of one text, or the places of a frequent window, are dealt.
SALTS = 64
#: One text in so many is looked at for frequent grams; a gram in ``FREQUENT`` of these is one.
SAMPLED = 64
FREQUENT = 8
#: Most frequent grams, and most texts with more than ``SALTS`` copies, that are broadcast.
MOST_BROADCAST = 10_000


def units_of(text: Column) -> Column:
    """The text's words with the blanks before them (blanks at the end are one more unit); joined, they are the text."""
    return F.split(text, CUT)


def word_count(text: Column) -> Column:
    unspaced = (F.octet_length(text) > F.length(text)) & text.rlike(f"[{UNSPACED}]")
    every = F.size(F.filter(units_of(text), lambda w: F.btrim(w, F.lit(BLANK)) != ""))
    bare = F.btrim(text, F.lit(BLANK))
    return F.when(unspaced, every).when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, r"\s+")))


def _odd(text: Column) -> Column:
    """Whether words may end elsewhere than at blanks and line feeds."""
    unspaced = (F.octet_length(text) > F.length(text)) & text.rlike(f"[{_ABOUT}]") & text.rlike(f"[{UNSPACED}]")
    return reduce(Column.__or__, [F.contains(text, F.lit(c)) for c in "\t\x0b\f\r"]) | unspaced


def _crowded(blanked: Column) -> Column:
    """Whether a text, with its line feeds as blanks, has blanks at an end or next to each other."""
    return F.contains(blanked, F.lit("  ")) | F.startswith(blanked, F.lit(" ")) | F.endswith(blanked, F.lit(" "))


def with_words(texts: DataFrame, into: str, apart: str | None = None) -> DataFrame:
    """Adds ``into``: the words of ``text``, which is not null, with a blank between each two.

    ``apart`` tells whether more than its line feeds have to be changed for that; if there is no such column, it is added.

    Only this string passes between compiled and other operators: arrays of words would be copied each time.
    """
    text, blanked = F.col("text"), F.col("_blanked")
    pulled = F.btrim(F.regexp_replace(F.regexp_replace(text, f"([{UNSPACED}])", " $1 "), "\\s+", " "), F.lit(" "))
    made = texts.withColumn("_blanked", F.replace(text, F.lit("\n"), F.lit(" ")))
    if apart not in texts.columns:
        made = made.withColumn(apart or "_apart", _odd(text) | _crowded(blanked))
    return made.withColumn(into, F.when(F.col(apart or "_apart"), pulled).otherwise(blanked)).drop("_blanked", *([] if apart else ["_apart"]))


def with_rest(texts: DataFrame, runs: str, into: str) -> DataFrame:
    """Adds ``text`` without the words of ``runs`` and the blanks before them; null where ``runs`` is."""
    single, units, blanked = fresh(texts, "_single"), fresh(texts, "_units"), fresh(texts, "_blanked")
    text, cut, unit = F.col("text"), F.col(runs), F.col(units)
    # where one blank or line feed stands between words, a split at blanks does; a line feed goes with the word after it
    made = texts.withColumn(blanked, F.when(cut.isNotNull(), F.replace(text, F.lit("\n"), F.lit(" "))))
    made = made.withColumn(single, cut.isNotNull() & ~_odd(text) & ~_crowded(F.col(blanked))).drop(blanked)
    plain = F.split(F.replace(text, F.lit("\n"), F.lit(" \n")), " ")
    made = made.withColumn(units, F.when(F.col(single), plain).when(cut.isNotNull(), units_of(text)))
    begins = F.concat(F.array(F.lit(0)), F.transform(cut, lambda r: r["end"]))
    ends = F.concat(F.transform(cut, lambda r: r["start"]), F.array(F.size(unit)))
    kept = F.flatten(F.zip_with(begins, ends, lambda a, b: F.slice(unit, a + 1, b - a)))
    lead = F.when((F.get(cut, F.lit(0))["start"] == 0) & (F.size(kept) > 0), F.lit(" ")).otherwise("")
    spaced = F.replace(F.concat(lead, F.array_join(kept, " ")), F.lit(" \n"), F.lit("\n"))
    return made.withColumn(into, F.when(F.col(single), spaced).otherwise(F.array_join(kept, ""))).drop(single, units)


def _hashed(texts: DataFrame, *columns: str) -> DataFrame:
    """Rows (columns, h: hashes of the text's words)."""
    return with_words(texts, "_words", "_apart").select(*columns, F.transform(F.split("_words", " "), lambda w: F.xxhash64(w)).alias("h"))


def _hash_at(place: Column) -> Column:
    return F.get(F.col("h"), place)


def _reach(at: Column, left: int, right: int) -> tuple[Column, Column]:
    """To how many places before, and after, no hash is less (after: nor equal), up to so many; beyond the text's ends none is."""

    def until(places, less):
        return F.coalesce(*[F.when(less(_hash_at(p), _hash_at(at)), n) for n, p in enumerate(places)], F.lit(len(places)))

    before, after = [at - j for j in range(1, left + 1)], [at + j for j in range(1, right + 1)]
    return until(before, lambda other, own: other < own), until(after, lambda other, own: other <= own)


def _grams(texts: DataFrame, min_words: int, gram: int) -> DataFrame:
    """Rows (k: gram, doc: its text, pos, apart: see ``with_words``) of all grams that windows choose, and some more.

    A window has ``width`` places to choose from.  With a place it holds the ``left`` ones before it or the ``right`` ones after it, so
    a chosen one is least among the former or the latter.  (To look at all ``width`` on both sides takes more code than the JVM compiles.)
    """
    width, pos = min_words - gram + 1, F.col("pos")
    left, right = width // 2, width - width // 2
    places = F.when(F.size("h") >= min_words, F.sequence(F.lit(0), F.size("h") - gram))
    every = _hashed(texts, "_text", "_apart").select(F.col("_text").alias("doc"), F.col("_apart").alias("apart"), "h", F.explode(places).alias("pos"))
    before, after = _reach(pos, left, right)
    chosen = every.where((after >= right) | (before >= left))
    return chosen.select(F.xxhash64(*[_hash_at(pos + j) for j in range(gram)]).alias("k"), "doc", "pos", "apart")


def _windows(texts: DataFrame, min_words: int, gram: int) -> DataFrame:
    """Rows (k, more: hashes of a window, base, start, frequent) of the windows that choose a gram which stands at two places."""
    width, place, start, last = min_words - gram + 1, F.col("place"), F.col("start"), F.size("h") - min_words
    told = texts.withColumn("_apart", F.get("_places", F.lit(0)).bitwiseAND(F.lit(2)) > 0)
    met = _hashed(told, "_base", "_places").select("_base", "h", F.explode("_places").alias("_place"))
    met = met.select("_base", "h", F.shiftright("_place", 2).alias("place"), (F.col("_place") % 2 == 1).alias("frequent"))
    before, after = _reach(place, width - 1, width - 1)
    first, to = F.greatest(place - before, F.lit(0)), F.least(place + after - (width - 1), place, last)
    met = met.select("_base", "h", "frequent", first.alias("first"), to.alias("to"))
    every = met.select("_base", "h", "frequent", F.explode(F.when(F.col("first") <= F.col("to"), F.sequence("first", "to"))).alias("start"))
    window = F.slice("h", start + 1, F.lit(min_words))
    return every.select(F.xxhash64(window).alias("k"), F.hash(window).alias("more"), F.col("_base").alias("base"), "start", "frequent")


def _frequent(grams: DataFrame) -> DataFrame:
    """Rows (k): grams that stand in many of the texts of the sample."""
    counted = grams.select("k", "doc").distinct().groupBy("k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FREQUENT)
    return counted.orderBy(F.desc("n"), "k").limit(MOST_BROADCAST).select("k")


def _met(grams: DataFrame, frequent: DataFrame) -> DataFrame:
    """Rows (doc, place) whose gram stands at another place as well; ``place`` is four times the position, two more if the words of the
    text have to be pulled apart, which so needs no second look at it, and one more if the gram is frequent."""
    marked = grams.join(F.broadcast(frequent.select(F.col("k").alias("_k"))), F.col("k") == F.col("_k"), "left").withColumn("frequent", F.col("_k").isNotNull())
    place = F.xxhash64("doc", "pos")
    dealt = marked.select(F.when(F.col("frequent"), place).otherwise(F.col("k")).alias("k"), "doc", (F.col("pos") * 4 + F.col("apart").cast("int") * 2 + F.col("frequent").cast("int")).alias("place"))
    same, at = W.partitionBy("k"), F.xxhash64("doc", "place")
    told = dealt.select("doc", "place", F.min(at).over(same).alias("a"), F.max(at).over(same).alias("b"))
    return told.where("a <> b or place % 2 = 1").select("doc", "place")


def _later(windows: DataFrame, path: str) -> DataFrame:
    """Rows (base, start): the windows that stand earlier."""
    salt = F.pmod(F.xxhash64("base", "start"), F.lit(SALTS))
    part, k = F.when(F.col("frequent"), F.xxhash64("k", salt)).otherwise(F.col("k")), F.when(F.col("frequent"), F.col("k"))
    dealt = windows.select(part.alias("part"), k.alias("k"), "more", "start", "frequent", (F.col("base") + F.col("start")).alias("place"))
    before = lambda by: F.lag("place").over(W.partitionBy(by, "more").orderBy("place"))
    told = dealt.withColumn("before", before("part")).withColumn("later", F.coalesce(F.col("before") < F.col("place"), F.lit(False)))
    told = told.where(F.col("later") | F.col("frequent") & F.col("before").isNull())
    told = written(told.select((F.col("place") - F.col("start")).alias("base"), "start", "later", *[F.when(~F.col("later"), F.col(c)).alias(c) for c in ("k", "more", "place")]), path)
    firsts = told.where("not later").withColumn("before", before("k")).where("before < place")
    return told.where("later").select("base", "start").unionByName(firsts.select("base", "start"))


def _runs(later: DataFrame, min_words: int) -> DataFrame:
    """Rows (base, runs): windows that overlap or touch are one."""
    order = W.partitionBy("base").orderBy("start")
    opens = later.withColumn("opens", F.when(F.col("start") - F.lag("start").over(order) <= min_words, 0).otherwise(1))
    numbered = opens.withColumn("run", F.sum("opens").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    joined = numbered.groupBy("base", "run").agg(F.min("start").alias("start"), (F.max("start") + min_words).alias("end"))
    return joined.groupBy("base").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("runs"))


def repeated_runs(docs: DataFrame, key: str = "doc_id", min_words: int = 25) -> DataFrame:
    """Rows (key, _text: hash of the text, runs, copy) of the texts to cut: ``runs`` are disjoint and sorted, with first and next word
    (``start``, ``end``); ``copy``: the whole text stands in a document with a smaller key."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "line-dedup")
    gram = min(GRAM, min_words)
    named = docs.where(F.col(key).isNotNull() & F.col("text").isNotNull()).select(key, F.xxhash64("text").alias("_text"), "text")

    # whole copies, and the place of every other text
    whole_text = ["_text", "_more", "_size"]
    own = named.select(key, "_text", F.hash("text").alias("_more"), (F.length("text") + 1).alias("_size")).distinct()
    own = written(own, f"{folder}/own")
    first = own.groupBy(*whole_text).agg(F.min(key).alias("_first"), F.count(F.lit(1)).alias("_keys")).where("_keys > 1")
    first = written(first, f"{folder}/first")
    many = first.where(F.col("_keys") > SALTS).orderBy(F.desc("_keys"), *whole_text).limit(MOST_BROADCAST).select(F.col("_text").alias("_many"), "_first")
    many = written(many.groupBy("_many").agg(F.min("_first").alias("_least")), f"{folder}/many")
    first = first.drop("_keys").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # copies of one text meet in many tasks
    salted = own.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
    marked = salted.join(first.hint("merge"), [*whole_text, "_salt"], "left").select(key, "_text", "_size", F.coalesce(F.col(key) > F.col("_first"), F.lit(False)).alias("_copy"))
    marked = written(marked, f"{folder}/marked")
    placed = written(preceding_sum(marked.where("not _copy").drop("_copy"), [key, "_text"], "_size", "_base", f"{folder}/order"), f"{folder}/placed")

    # grams that stand at two places, gathered per text
    once = named.join(F.broadcast(many), F.col("_text") == F.col("_many"), "left").where(F.col("_many").isNull() | (F.col(key) == F.col("_least"))).select("_text", "text")
    frequent = written(_frequent(_grams(once.where(F.pmod("_text", F.lit(SAMPLED)) == 0), min_words, gram)), f"{folder}/frequent")
    places = _met(_grams(once, min_words, gram), frequent).groupBy("doc").agg(F.collect_set("place").alias("_places"))
    around = written(places.join(placed, F.col("doc") == F.col("_text")).select(key, "_text", "_base", "_places"), f"{folder}/around")

    # windows around them that stand earlier, joined to runs
    texts = named.join(around.hint("shuffle_hash"), [key, "_text"]).select("_base", "_places", "text")
    runs = _runs(_later(_windows(texts, min_words, gram), f"{folder}/later"), min_words)
    cut = runs.join(placed, F.col("base") == F.col("_base")).select(key, "_text", "runs", F.lit(False).alias("copy"))
    copies = marked.where("_copy").select(key, "_text", F.lit(None).cast(cut.schema["runs"].dataType).alias("runs"), F.lit(True).alias("copy"))
    out = written(cut.unionByName(copies), f"{folder}/runs")
    for part in ("own", "first", "many", "marked", "order", "placed", "frequent", "around", "later"):
        delete_path(spark, f"{folder}/{part}")
    return out


def dedup_lines(docs: DataFrame, key: str = "doc_id", min_words: int = 25) -> DataFrame:
    """All columns of ``docs`` with the text's later repeated runs deleted, and ``_removed`` (in place of one that was there): the number of deleted words."""
    own = [c for c in docs.columns if c != "_removed"]
    of, mine, name, copy, count, left = (fresh(docs, c) for c in ("_of", "_text_hash", "_runs", "_copy", "_count", "_left"))
    runs = repeated_runs(docs.select(key, "text"), key, min_words).select(
        F.col(key).alias(of), F.col("_text").alias(mine), F.col("runs").alias(name), F.col("copy").alias(copy)
    )
    joined = docs.join(runs.hint("shuffle_hash"), (F.col(key) == F.col(of)) & (F.xxhash64("text") == F.col(mine)), "left")
    text, cut, size = F.col("text"), F.col(name), F.col(count)
    sized = joined.withColumn(count, F.when(F.col(copy), word_count(text)))
    sized = with_rest(sized, name, left)
    kept = F.when(F.btrim(left, F.lit(BLANK)) == "", F.lit("")).otherwise(F.col(left))
    return sized.select(
        *[(F.when(cut.isNotNull(), kept).when(size >= min_words, F.lit("")).otherwise(text) if c == "text" else F.col(f"`{c}`")).alias(c) for c in own],
        F.when(cut.isNotNull(), F.aggregate(cut, F.lit(0).cast("bigint"), lambda n, r: n + r["end"] - r["start"]).cast("int")).when(size >= min_words, size).otherwise(0).alias("_removed"),
    )
