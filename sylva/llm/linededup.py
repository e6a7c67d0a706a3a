"""Line dedup by a segment-partition edit join, in DataFrame operations alone.

A line is cut into ``max_edits + 1`` segments. Two lines within ``max_edits`` share a segment of the shorter one, at a
place that its number and the lengths' difference confine to a few positions. So each distinct line is indexed under
(its length, segment number, segment), and probes the indexes of its own and the next shorter lengths with the substrings
at those positions only. Pairs that meet are verified on their texts by a banded bit-parallel edit distance.

Keys are 64-bit hashes, so lines' texts move once, and only those of lines that met another (and what shares a bit of
their hash filter). A segment that more than ``hot`` distinct lines share is not paired up: what is left of these lines
without it is cut into ``max_edits + 1`` segments in turn, and so on until few lines agree in all that was taken out. So
the method is one at all sizes. Where nothing is left to cut, lines differ in ``max_edits`` characters at one place at
most, and a link of each to the smallest connects them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylva.llm.common import connected_components, forget, stored

#: Lines shorter than this are in one class with their equals only.
MIN_CHARS, MAX_EDITS, HOT = 24, 1, 32
#: Hash values of the filter in front of the texts' shuffle: it is broadcast and never has more rows than this.
FILTER_VALUES = 1 << 20


def document_lines(documents: DataFrame) -> DataFrame:
    """doc_id, text_hash, line_no (from 0) and line of every line that is not empty, outer spaces aside."""
    text = F.col("text").cast("string")
    return (
        documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
        .select("doc_id", "text_hash", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
        .select("doc_id", "text_hash", "line_no", F.trim("line").alias("line"))
        .where("line <> ''")
    )


def _hashes(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("line"), line).alias("h2")]


def _segment(length: Column, number: Column, parts: int) -> tuple[Column, Column]:
    """Start (from 0) and size of a segment of a line of ``length``; the last ones take what does not divide."""
    base = F.floor(length / parts).cast("int")
    first_longer = F.lit(parts) - (length - base * parts).cast("int")
    start = base * (number - 1) + F.greatest(F.lit(0), number - 1 - first_longer)
    return start.cast("int"), (base + F.when(number > first_longer, 1).otherwise(0)).cast("int")


def _places(edits: int) -> list[tuple[int, int, int]]:
    """(gap, number, shift): a line probes the segment ``number`` of lines that are ``gap`` shorter, ``shift`` further on.

    No edit before the segment means no shift, and each edit accounts for one at most, on either side.
    """
    parts, out = edits + 1, []
    for gap in range(edits + 1):
        for number in range(1, parts + 1):
            low, high = max(-(number - 1), gap - (parts - number)), min(number - 1, gap + (parts - number))
            out += [(gap, number, shift) for shift in range(low, high + 1)]
    return out


def _keys(line: Column, length: Column, edits: int) -> list[Column]:
    """A key for each of ``_places``; those without gap and shift are the line's index keys."""
    out = []
    for gap, number, shift in _places(edits):
        start, size = _segment(length - gap, F.lit(number), edits + 1)
        at = start + shift
        key = F.xxhash64(length - gap, F.lit(number), F.substr(line, at + 1, size))
        out.append(F.when((at >= 0) & (at + size <= length), key))
    return out


def _without(text: Column, at: Column, size: Column) -> Column:
    return F.concat(F.substr(text, F.lit(1), at), F.substr(text, at + size + 1))


def _paired(rows: DataFrame, node: str, hot: int) -> tuple[DataFrame, DataFrame]:
    """(a, b) of ``rows(key, <node>, own, ...)`` that meet in a key of up to ``hot`` rows, and the other keys."""
    counts = rows.groupBy("key").agg(F.count("*").alias("n"), F.max("own").alias("owned")).where("n > 1 AND owned")
    calm = rows.join(counts.where(F.col("n") <= hot).select("key"), "key")
    a = calm.where("own").select("key", F.col(node).alias("a"))
    b = calm.select("key", F.col(node).alias("b"), F.col("own").alias("b_own"))
    pairs = a.join(b, "key").where("(b_own AND a < b) OR (NOT b_own AND a <> b)")
    return (
        pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
        counts.where(F.col("n") > hot).select("key"),
    )


def _split_again(rows: DataFrame, edits: int, hot: int) -> DataFrame:
    """(a, b) of ``rows(key, id, own, gap, rest)`` that meet in more segments, where the first one was too common."""
    found = None
    while True:
        size = (F.char_length("rest") - F.col("gap")).cast("int")
        last = rows.where(size <= edits)
        links = _last_links(last)
        found = links if found is None else found.union(links)
        by_gap = F.array(*[
            F.array(*[F.struct(F.lit(n).alias("number"), F.lit(s).alias("shift")) for g, n, s in _places(edits) if g == gap])
            for gap in range(edits + 1)
        ])
        cut = rows.where(size > edits).select(
            "key", "id", "own", "gap", "rest", size.alias("short"), F.explode(F.get(by_gap, F.col("gap"))).alias("p")
        )
        start, length = _segment(F.col("short"), F.col("p.number"), edits + 1)
        at = (start + F.col("p.shift")).cast("int")
        cut = cut.select("*", at.alias("at"), length.alias("length")).where("at >= 0 AND at + length <= char_length(rest)")
        cut = cut.select(
            F.xxhash64("key", "p.number", F.substr("rest", F.col("at") + 1, F.col("length"))).alias("key"), "id",
            (F.col("own") & (F.col("p.shift") == 0)).alias("own"), "gap", _without(F.col("rest"), F.col("at"), F.col("length")).alias("rest"),
        )
        cut = stored(cut.distinct(), "line-parts")
        pairs, busy = _paired(cut, "id", hot)
        found = found.union(pairs)
        rows = stored(cut.join(busy, "key", "left_semi"), "line-rests")
        if not rows.take(1):
            return found.distinct()


def _last_links(rows: DataFrame) -> DataFrame:
    """Links of rows that agree in all but a few characters of one place.

    Index rows are linked to their smallest. A probe is linked to that and to the index rows that share a character of
    the rest: with none in common its distance to all of them is the length of the longer rest.
    """
    own = rows.where("own")
    least = own.groupBy("key").agg(F.min("id").alias("a"))
    stars = rows.join(least, "key").where("a <> id").select("a", F.col("id").alias("b"))
    letters = rows.withColumn("letter", F.explode(F.split("rest", "")))
    shared = letters.where("own").select("key", "letter", F.col("id").alias("a")).join(
        letters.where("NOT own").select("key", "letter", F.col("id").alias("b")), ["key", "letter"]).where("a <> b").select("a", "b")
    return stars.union(shared).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def within(longer: Column, shorter: Column, edits: int) -> Column:
    """Whether two arrays of characters are within ``edits`` edits; the first has as many characters or more.

    One machine word holds the band of ``2 edits + 1`` diagonals (Myers 1999, Hyyrö 2003): bit r of column j stands for
    row j - edits + r, and the differences down a column, +1 and -1, are a bit each. Along the last cell's diagonal the
    distance grows by one wherever the diagonal bit is off.
    """
    width = 2 * edits + 1
    mask, top = (1 << width) - 1, 1 << (width - 1)
    whole = lambda x: F.lit(x).cast("long")
    let = lambda value, use: F.transform(F.array(value), use)[0]
    m, n = F.size(longer), F.size(shorter)

    def column(state: Column, j: Column) -> Column:
        letter = F.get(shorter, j - 1)
        equal = whole(0)
        for r in range(width):
            row = j - edits + r
            equal = equal + F.when((row >= 1) & (row <= m) & (F.get(longer, F.greatest(row - 1, F.lit(0))) == letter), whole(1 << r)).otherwise(whole(0))
        up, down = state["up"], state["down"]

        def after(diagonal: Column) -> Column:
            rises = down.bitwiseOR(F.bitwise_not(diagonal.bitwiseOR(up))).bitwiseAND(whole(mask))
            falls = diagonal.bitwiseAND(up)
            half = F.shiftright(diagonal, 1)
            lower = whole(mask ^ top)
            return F.struct(
                falls.bitwiseOR(F.bitwise_not(half.bitwiseOR(rises))).bitwiseAND(lower).bitwiseOR(whole(top)).alias("up"),
                half.bitwiseAND(rises).bitwiseAND(lower).alias("down"),
                (state["distance"] + 1 - F.call_function("shiftright", diagonal, m - n + edits).bitwiseAND(whole(1))).cast("long").alias("distance"),
            )

        return let(equal, lambda eq: let(
            (eq.bitwiseAND(up) + up).bitwiseXOR(up).bitwiseOR(eq).bitwiseOR(down).bitwiseAND(whole(mask)), after))

    start = F.struct(whole(mask ^ ((1 << edits) - 1)).alias("up"), whole(0).alias("down"), (m - n).cast("long").alias("distance"))
    distance = F.aggregate(F.sequence(F.lit(1), n), start, column)["distance"]
    return (m - n <= edits) & F.when(n == 0, m <= edits).otherwise(distance <= edits)


def _letters(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))


def _unshared(pair: Column, front: bool) -> Column:
    """(x, y) without the front or back half of the shorter one where both have it; their distance is the same."""
    x, y = pair["x"], pair["y"]
    half = F.floor(F.least(F.char_length(x), F.char_length(y)) / 2).cast("int")
    if front:
        same, rest = F.left(x, half) == F.left(y, half), lambda t: F.substr(t, half + 1)
    else:
        same, rest = F.right(x, half) == F.right(y, half), lambda t: F.left(t, F.char_length(t) - half)
    return F.struct(F.when(same, rest(x)).otherwise(x).alias("x"), F.when(same, rest(y)).otherwise(y).alias("y"))


def _texts(documents: DataFrame, min_chars: int, wanted: DataFrame) -> DataFrame:
    """id, h1, h2 and line of the distinct lines that ``wanted(h1)`` names; ids are numbers of the stored rows."""
    low = F.pmod(F.col("h1"), F.lit(FILTER_VALUES)).cast("int").alias("low")
    seen = wanted.select(low).distinct()  # at most FILTER_VALUES rows of 4 bytes, however many lines are wanted
    lines = document_lines(documents).where(F.char_length("line") >= min_chars).select("line", *_hashes(F.col("line")))
    found = (
        lines.withColumn("low", low).join(F.broadcast(seen), "low", "left_semi")
        .groupBy("h1", "h2").agg(F.first("line").alias("line"))
        .join(wanted, "h1", "left_semi")
    )
    return stored(found.select(F.monotonically_increasing_id().alias("id"), "h1", "h2", "line"), "line-texts")


def _links(distinct: DataFrame, documents: DataFrame, edits: int, min_chars: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b) between ids of the second table, which holds h1, h2 and line of these ids."""
    places = _places(edits)
    keyed = distinct.select("h1", F.posexplode(F.array(*[f"k{i}" for i in range(len(places))])).alias("place", "key")).where(
        "key IS NOT NULL").withColumn("own", F.col("place").isin(*[i for i, (gap, _, shift) in enumerate(places) if gap == shift == 0]))
    pairs, busy = _paired(keyed, "h1", hot)
    pairs = stored(pairs, "line-pairs")
    busy = stored(keyed.join(busy, "key").select("key", "h1", "place", "own"), "busy-lines")
    wanted = pairs.select(F.col("a").alias("h1")).union(pairs.select("b")).union(busy.select("h1")).distinct()
    texts = _texts(documents, min_chars, wanted)
    ids = lambda c: texts.select(F.col("h1").alias(c), F.col("id").alias(f"{c}_id"))
    met = pairs.join(ids("a"), "a").join(ids("b"), "b").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    if busy.take(1):
        place = F.get(F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(("gap", "number", "shift"), p)]) for p in places]), F.col("place"))
        rows = busy.join(texts, "h1").withColumn("p", place)
        start, size = _segment(F.char_length("line") - F.col("p.gap"), F.col("p.number"), edits + 1)
        rows = rows.select("key", "id", "own", F.col("p.gap").alias("gap"), _without(F.col("line"), start + F.col("p.shift"), size).alias("rest"))
        met = met.union(_split_again(rows, edits, hot))
    line = lambda c: texts.select(F.col("id").alias(c), F.col("line").alias(f"line_{c}"))
    both = met.distinct().join(line("a"), "a").join(line("b"), "b").where("line_a <> line_b")
    # Values are bound to variables, as the optimizer would put the cutting and splitting into each step of the distance.
    bound = lambda value, use: F.transform(F.array(value), use)[0]
    pair = F.struct(F.col("line_a").alias("x"), F.col("line_b").alias("y"))
    cut = lambda front: lambda p: _unshared(p, front)
    for front in (True, False) * 2:
        pair = bound(pair, cut(front))
    swap = lambda p: F.char_length(p["x"]) < F.char_length(p["y"])
    letters = bound(pair, lambda p: F.struct(
        _letters(F.when(swap(p), p["y"]).otherwise(p["x"])).alias("longer"), _letters(F.when(swap(p), p["x"]).otherwise(p["y"])).alias("shorter")))
    links = both.where(bound(letters, lambda p: within(p["longer"], p["shorter"], edits))).select("a", "b")
    return links, texts


def _marked(documents: DataFrame, max_edits: int, min_chars: int, hot: int) -> DataFrame:
    """doc_id, text_hash, line_no, h1, h2 and head (doc_id, text_hash, line_no of the class's first line) of every line."""
    line, size = F.col("line"), F.char_length("line")
    keys = _keys(line, size, max_edits)
    names = [f"k{i}" for i in range(len(keys))]
    marked = stored(document_lines(documents).select(
        "doc_id", "text_hash", "line_no", (size >= min_chars).alias("near"), *_hashes(line), *[k.alias(n) for n, k in zip(names, keys)]), "lines")
    distinct = stored(marked.groupBy("h1", "h2", "near", *names).agg(
        F.min(F.struct("doc_id", "text_hash", "line_no")).alias("first")), "distinct-lines")
    links, texts = _links(distinct.where("near"), documents, max_edits, min_chars, hot)
    parts = connected_components(links).join(texts.select(F.col("id").alias("node"), "h1", "h2"), "node").select("h1", "h2", "component")
    joined = distinct.join(parts, ["h1", "h2"]).select("h1", "h2", "first", "component")
    merged = joined.join(joined.groupBy("component").agg(F.min("first").alias("head")), "component").select("h1", "h2", "head")
    # Stored, so that both sides of the last join come straight from exchanges and AQE can split a common line.
    heads = stored(distinct.select("h1", "h2", "first").join(merged, ["h1", "h2"], "left").select(
        "h1", "h2", F.coalesce("head", "first").alias("head")
    ), "line-heads")
    return marked.select("doc_id", "text_hash", "line_no", "h1", "h2").join(heads, ["h1", "h2"])


def _is_head() -> Column:
    same = F.lit(True)
    for c in ("doc_id", "text_hash", "line_no"):
        same = same & F.col(c).eqNullSafe(F.col(f"head.{c}"))
    return same


def line_classes(documents: DataFrame, max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS, hot: int = HOT) -> DataFrame:
    """Each line that is not empty, with the first line of its class and whether it is that line.

    Outer spaces aside, lines of at least ``min_chars`` characters within ``max_edits`` edits are linked, and a class is
    what links connect; shorter lines are in one class with their equals. First is the smallest (doc_id, hash of the
    text, line_no); a null doc_id comes before all. Rows with one doc_id, or none, are apart if their texts differ; rows
    equal in both are one document, whose first line is kept in each. Null and empty texts have no lines; an empty table
    gives an empty result.
    """
    return _marked(documents, max_edits, min_chars, hot).select(
        "doc_id", "line_no", F.col("head.doc_id").alias("class_doc_id"), F.col("head.line_no").alias("class_line_no"),
        _is_head().alias("kept"),
    )


def dedup_lines(documents: DataFrame, max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS, hot: int = HOT) -> DataFrame:
    """``documents`` without the lines that are not the first of their class; all rows and columns stay.

    Lines go by the document that they stand in, a doc_id with a text, so texts under one doc_id (or none) lose their own
    lines only. Empty lines stay. Where there is a column ``n_chars`` it follows the text. A text of which no line is
    left is empty; null texts stay null.
    """
    name = f"gone-{uuid.uuid4().hex}"
    text = F.col("text").cast("string")
    document = lambda i, t: F.struct(i.cast("long").alias("doc_id"), t.alias("text_hash"))
    gone = _marked(documents, max_edits, min_chars, hot).where(~_is_head()).groupBy("doc_id", "text_hash").agg(
        F.collect_set("line_no").alias("lines"))
    gone = gone.select(F.struct(document(F.col("doc_id"), F.col("text_hash")).alias("of"), "lines").alias(name))
    rows = documents.join(gone, document(F.col("doc_id"), F.xxhash64(text)).eqNullSafe(F.col(f"`{name}`.of")), "left")
    lines = F.col(f"`{name}`.lines")
    left = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(lines, i)), "\n")
    new = F.when(lines.isNull(), text).otherwise(left)
    columns = {"text": new}
    if "n_chars" in documents.columns:
        columns["n_chars"] = F.char_length(new).cast(documents.schema["n_chars"].dataType)
    return rows.select(*[columns.get(c, F.col(f"`{c}`")).alias(c) for c in documents.columns])


ORACLE_SQL = f"""
WITH RECURSIVE l AS (
  SELECT doc_id, (i - 1)::INTEGER AS line_no, trim(parts[i]) AS line
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i
        FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL))
), t AS (SELECT * FROM l WHERE line <> ''),
d AS (SELECT line, length(line) AS n, min(struct_pack(doc_id := doc_id, line_no := line_no)) AS first FROM t GROUP BY line),
e AS (
  SELECT a.line AS a, b.line AS b FROM d a JOIN d b ON a.n >= {MIN_CHARS} AND b.n BETWEEN a.n AND a.n + {MAX_EDITS} AND a.line <> b.line
    AND (left(a.line, (a.n // 2)::BIGINT) = left(b.line, (a.n // 2)::BIGINT)
      OR right(a.line, (a.n - a.n // 2)::BIGINT) = right(b.line, (a.n - a.n // 2)::BIGINT))
  WHERE levenshtein(a.line, b.line) <= {MAX_EDITS}
), both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT DISTINCT a AS s, a AS x FROM both_ways UNION SELECT reach.s, b FROM reach JOIN both_ways ON reach.x = both_ways.a),
head AS (SELECT s AS line, min(first) AS head FROM reach JOIN d ON d.line = reach.x GROUP BY s)
SELECT t.doc_id, t.line_no, coalesce(head.head, d.first).doc_id AS class_doc_id,
  coalesce(head.head, d.first).line_no AS class_line_no,
  (t.doc_id = coalesce(head.head, d.first).doc_id AND t.line_no = coalesce(head.head, d.first).line_no) AS kept
FROM t JOIN d USING (line) LEFT JOIN head USING (line)
"""
