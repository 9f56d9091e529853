"""Line dedup by a segment-partition edit join, with DataFrame functions only.

A document's lines are what lies between line breaks, without the white space around them.  Lines of at least ``min_chars``
characters within ``threshold`` edits of each other (insertions, deletions, replacements) are linked; linked and equal lines form classes; of each class the
first line (smallest doc_id, then position) is kept and all others are dropped.  Shorter lines stay, or with ``short`` form
classes of exact repeats; links are for lines of ``min_chars`` only.

* *Segments.*  A line of length l is cut into ``threshold + 1`` segments, so a line within that many edits holds one of them
  unchanged.  The index has a key for (l, number, segment); a line of length n probes, for each l from n - threshold to n,
  only the substrings whose place is compatible with the edits left and right of them (the multi-match-aware range).  Index and
  probes are rows of a hashed key and the line's hash.  Probes meet the hub of their key first, one indexed line; only lines that
  share a key with several indexed ones and aren't connected by then are paired, where the profiles of their letters are close
  enough for the threshold (see :func:`links`).  Each pair is verified on its text.
* *Verification.*  Of eight parts of the shorter line all but ``threshold`` must occur near their places; common parts at both
  ends are cut off; the rest goes through a banded bit-parallel automaton (one 2 t + 2 bit word of vertical differences a
  character, moved along the diagonal), an ``aggregate`` over the characters.
* Exact repeats are counted first, by digest with partial aggregation, so a line that a third of all documents hold is one row
  from there on; classes come from components of the links; only lines that repeat or link meet the documents again.

Equal lines are told by 128 bits of hashes.  The search for links goes by 64 of them: of lines that share those by chance (one
pair in 2**64) only the first in order is searched.

Defined cases: a null text has one empty line and stays null; empty lines always stay; rows with a null doc_id take no part and
stay as they are; rows that repeat a doc_id are one document; keys are integers; other columns are kept by :func:`apply`; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._graph import components
from ._shared import cut, spare

THRESHOLD = 2
MIN_CHARS = 20
PARTS = 8


def _lines(docs: DataFrame, min_chars: int, key: str, text: str) -> DataFrame:
    """doc, pos, h1, h2, line: every line that takes part."""
    exploded = docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("pos", "raw"))
    trimmed = exploded.select("doc", "pos", F.btrim("raw", F.lit(" \t\r")).alias("line")).filter(F.length("line") >= min_chars)
    return trimmed.select("doc", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2"), "line")


def segment(length: Column, i: Column, threshold: int) -> tuple[Column, Column]:
    """Start (from 0) and size of segment i of a line of that length: even sizes, the longer ones last."""
    parts = threshold + 1
    base = F.floor(length / parts).cast("int")
    short = F.lit(parts) - length % parts
    return base * i + F.greatest(F.lit(0), i - short), base + F.when(i >= short, 1).otherwise(0)


def index_places(threshold: int) -> list[tuple[int, int, int]]:
    """(difference of lengths, segment, shift) of a line's own segments."""
    return [(0, i, 0) for i in range(threshold + 1)]


def probe_places(threshold: int) -> list[tuple[int, int, int]]:
    """The same of every substring that could be an indexed segment of a line at most as long."""
    out = []
    for shorter in range(threshold + 1):
        for i in range(threshold + 1):
            left, right = i, threshold - i
            out += [(shorter, i, shift) for shift in range(max(-left, shorter - right), min(left, shorter + right) + 1)]
    return out


def keyed(once: DataFrame, places: list[tuple[int, int, int]], threshold: int) -> DataFrame:
    """(key, h1): a row for each line and place.  The last bit of a key marks a line's own segments.

    The places are exploded before the substrings are taken: one short expression then serves all, which the virtual machine
    compiles; lines of ASCII only are cut by bytes, without counting characters.
    """
    rows = F.array(*[F.struct(F.lit(a).alias("shorter"), F.lit(i).alias("i"), F.lit(s).alias("shift")) for a, i, s in places])
    line, n = F.col("line"), F.length("line")
    held = once.select("h1", "line", n.alias("n"), F.when(F.octet_length("line") == n, line.cast("binary")).alias("raw")).withColumn("at", F.explode(rows))
    length, i = F.col("n") - F.col("at.shorter"), F.col("at.i")
    start, size = segment(length, i, threshold)
    start = start + F.col("at.shift") + 1
    hashed = F.when(F.col("raw").isNotNull(), F.xxhash64(length, i, F.substring("raw", start, size))).otherwise(F.xxhash64(length, i, F.substring("line", start, size)))
    own = F.when((F.col("at.shorter") == 0) & (F.col("at.shift") == 0), 1).otherwise(0).cast("long")
    return held.select(_bare(hashed).bitwiseOR(own).alias("key"), "h1")


def _bare(key: Column) -> Column:
    """A key without its last bit."""
    return key.bitwiseAND(F.lit(-2).cast("long"))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: without the name, the planner would copy the value to every use."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Letters whose occurrences are counted.
COUNTED = "etaoinshrdlucmfw"


def profile(line: Column) -> Column:
    """How often each of sixteen letters occurs, modulo 16: four bits a letter."""
    n, out = F.octet_length(line), F.lit(0).cast("long")
    for k, letter in enumerate(COUNTED):
        out = out.bitwiseOR(F.shiftleft((n - F.octet_length(F.replace(line, F.lit(letter), F.lit("")))).bitwiseAND(F.lit(15)).cast("long"), 4 * k))
    return out


def alike(a: Column, b: Column, threshold: int) -> Column:
    """Whether the profiles are as close as those of lines within the threshold must be: an edit moves at most two counts by one."""
    low = F.lit(15).cast("long")
    total = F.lit(0)
    for k in range(len(COUNTED)):
        gap = (F.shiftright(a, 4 * k).bitwiseAND(low) - F.shiftright(b, 4 * k).bitwiseAND(low)).bitwiseAND(low)
        total = total + F.least(gap, F.lit(16) - gap)
    return total <= 2 * threshold


def banded_distance(a: Column, b: Column, threshold: int) -> Column:
    """The edit distance of two strings whose lengths differ by at most ``threshold``, if it is at most that; else something larger.

    Bit-parallel: bit k of a word stands for the k-th row of a band that moves down the diagonal with each character of b.
    """
    bits = 2 * threshold + 2
    full, bottom = F.lit((1 << bits) - 1).cast("long"), F.lit(1 << (bits - 1)).cast("long")
    zero = F.lit(0).cast("long")

    def walk(t: Column) -> Column:
        """t holds the characters of both strings."""
        start = F.struct(F.lit(((1 << (threshold + 1)) - 1) << (bits - threshold - 1)).cast("long").alias("vp"), zero.alias("vn"), F.lit(threshold).alias("dist"))

        def step(s: Column, j: Column) -> Column:
            here = F.get(t["b"], j - 1)
            match = zero
            for k in range(bits):
                row = j + (threshold - bits + k)
                match = match + F.when((row >= 0) & (F.get(t["a"], row) == here), 1 << k).otherwise(0)

            def moved(x: Column) -> Column:
                d0 = (x.bitwiseAND(s["vp"]) + s["vp"]).bitwiseXOR(s["vp"]).bitwiseOR(x).bitwiseOR(s["vn"]).bitwiseAND(full)
                return let(d0, closed)

            def closed(d0: Column) -> Column:
                hp = s["vn"].bitwiseOR(F.bitwise_not(d0.bitwiseOR(s["vp"])).bitwiseAND(full))
                return let(F.struct(hp.alias("hp"), d0.bitwiseAND(s["vp"]).alias("hn"), F.shiftright(d0, 1).alias("half"), d0.alias("d0")), next_state)

            def next_state(w: Column) -> Column:
                # On the diagonal while its row is within a; then along the last row, one bit higher each time.
                beyond = j - (t["m"] - threshold)
                mask = F.call_function("shiftright", bottom, F.greatest(beyond, F.lit(0)))
                straight = F.when(w["hp"].bitwiseAND(mask) != 0, 1).when(w["hn"].bitwiseAND(mask) != 0, -1).otherwise(0)
                moved_by = F.when(beyond <= 0, F.when(w["d0"].bitwiseAND(bottom) != 0, 0).otherwise(1)).otherwise(straight)
                vp = w["hn"].bitwiseOR(F.bitwise_not(w["half"].bitwiseOR(w["hp"])).bitwiseAND(full))
                return F.struct(vp.alias("vp"), w["half"].bitwiseAND(w["hp"]).alias("vn"), (s["dist"] + moved_by).alias("dist"))

            return let(match, moved)

        return F.aggregate(F.sequence(F.lit(1), t["n"]), start, step, lambda s: s["dist"])

    def measured(t: Column) -> Column:
        # A band that reaches beyond row 0 of a short string starts below its last row: then count the plain way.
        chars = F.struct(F.split(t["a"], "").alias("a"), F.split(t["b"], "").alias("b"), F.length(t["a"]).alias("m"), F.length(t["b"]).alias("n"))
        return F.when(F.length(t["b"]) == 0, F.length(t["a"])).when(F.length(t["a"]) <= threshold, F.levenshtein(t["a"], t["b"])).otherwise(let(chars, walk))

    return let(F.struct(a.alias("a"), b.alias("b")), measured)


def near(a: Column, b: Column, threshold: int) -> Column:
    """Whether enough of eight parts of a occur near their places in b: true wherever the distance is within the threshold."""
    n = F.length(a)
    hits = F.lit(0)
    for p in range(PARTS):
        start = F.floor(n * p / PARTS).cast("int")
        size = F.floor(n * (p + 1) / PARTS).cast("int") - start
        low = F.greatest(start - threshold, F.lit(0))
        around = F.substring(b, low + 1, start - low + size + threshold)
        hits = hits + F.when(F.instr(around, F.substring(a, start + 1, size)) > 0, 1).otherwise(0)
    return hits >= PARTS - threshold


def stripped(pair: Column, right: bool) -> Column:
    """The pair (a, b) without the longest common run of eighths at one end; its distance stays the same."""
    take = F.right if right else F.left

    def cut_off(t: Column) -> Column:
        common = F.lit(0)
        for p in range(1, PARTS + 1):
            size = F.floor(t["n"] * p / PARTS).cast("int")
            common = F.when(take(t["a"], size) == take(t["b"], size), size).otherwise(common)
        rest = lambda x, c: F.left(x, F.length(x) - c) if right else F.substring(x, c + 1, F.length(x))
        return let(common, lambda c: F.struct(rest(t["a"], c).alias("a"), rest(t["b"], c).alias("b")))

    return let(F.struct(pair["a"].alias("a"), pair["b"].alias("b"), F.least(F.length(pair["a"]), F.length(pair["b"])).alias("n")), cut_off)


def distance(a: Column, b: Column, threshold: int) -> Column:
    """Common ends off, then the banded automaton."""
    whole = F.struct(a.alias("a"), b.alias("b"))
    return let(whole, lambda p: let(stripped(p, right=False), lambda q: let(stripped(q, right=True), lambda r: banded_distance(r["a"], r["b"], threshold))))


def _verified(pairs: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """Those of the pairs (a1, b1) that are within the threshold, with the second hashes of their lines."""
    a, b = (texts.select(F.col("h1").alias(f"{x}1"), F.col("line").alias(x), F.col("size").alias(f"{x}n"), F.col("letters").alias(f"{x}p")) for x in "ab")
    met = pairs.join(a, "a1").join(b, "b1").filter(F.abs(F.col("an") - F.col("bn")) <= threshold).filter(alike(F.col("ap"), F.col("bp"), threshold))
    met = met.filter(near(F.col("a"), F.col("b"), threshold)).filter(distance(F.col("a"), F.col("b"), threshold) <= threshold)
    second = lambda c: F.xxhash64(F.lit("second"), F.col(c))
    return cut(met.select("a1", second("a").alias("a2"), "b1", second("b").alias("b2")), "line-links")


def links(lines: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(a1, a2, b1, b2): links, by hashes of lines, that connect all lines within the threshold; ``lines`` has h1 and line, repeats allowed.

    A key's group holds the lines indexed under it and those that probe it; a group of one indexed line is settled by comparing
    that line, its hub, with the others.  Groups of several compare a first hub with all, then the indexed line that the
    first hubs met most often (of many variants of one text that tends to be the text), and at last every pair of lines that
    isn't connected yet, in a join on the key that admits only pairs of close letter profiles.
    """
    once = lines.groupBy("h1").agg(F.min("line").alias("line"))
    index = keyed(once, index_places(threshold), threshold)
    probes = keyed(once, probe_places(threshold), threshold).select(F.col("key").alias("probe"), "h1")
    hubs = index.groupBy(_bare(F.col("key")).alias("key")).agg(F.min("h1").alias("hub"), F.count("*").alias("n"))
    met = probes.join(hubs, (_bare(F.col("probe")) == F.col("key")) & ((F.col("n") > 1) | (F.col("h1") != F.col("hub"))))
    # The lines that met, with their groups (at most one a place) and texts, in the same query: it reads the exchange of the lines anew
    # instead of sending them twice.
    group = F.struct("key", "hub", "n", (F.col("probe").bitwiseAND(F.lit(1)) == 1).alias("indexed"))
    sides = F.array(F.struct(F.col("h1").alias("who"), group.alias("group")), F.struct(F.col("hub").alias("who"), F.when(F.lit(False), group).alias("group")))
    mine = met.select(F.explode(sides).alias("side")).groupBy("side.who").agg(F.collect_list("side.group").alias("groups"))
    texts = mine.join(once, mine["who"] == once["h1"]).select("h1", "line", F.length("line").alias("size"), profile(F.col("line")).alias("letters"), "groups")
    texts = cut(texts, "line-groups")
    met = texts.select("h1", F.explode("groups").alias("group")).select("group.key", "h1", "group.hub", "group.n", "group.indexed")
    pair = [F.col("hub").alias("a1"), F.col("h1").alias("b1")]
    found = _verified(met.filter("h1 <> hub").select(*pair).distinct(), texts, threshold)

    several = met.filter("n > 1").select("key", "h1", "hub", "indexed")
    if not several.isEmpty():
        degree = found.select(F.col("b1").alias("line")).groupBy("line").agg(F.count("*").alias("degree"))
        centre = several.filter("indexed AND h1 <> hub").join(degree, F.col("h1") == F.col("line")).groupBy("key").agg(F.max_by("h1", F.struct("degree", "h1")).alias("centre"))
        again = several.join(centre, "key").filter("h1 <> centre").select(F.col("centre").alias("a1"), F.col("h1").alias("b1")).distinct()
        found = found.unionByName(_verified(again, texts, threshold))
        found = found.unionByName(_verified(_apart(several, found, texts, threshold), texts, threshold))
    return found


def _apart(several: DataFrame, found: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """Pairs of lines that share a key, have close profiles and aren't connected by ``found``; those with the group's hub were compared before."""
    named = components(found, "a1", "b1")
    known = several.join(texts.select("h1", "size", "letters"), "h1").join(named, F.col("h1") == F.col("node"), "left")
    known = cut(known.select("key", "h1", "hub", "indexed", "size", "letters", F.coalesce("component", "h1").alias("part")), "line-groups")
    a = known.filter("indexed AND h1 <> hub").select("key", *(F.col(c).alias(f"a_{c}") for c in ("h1", "size", "letters", "part")))
    b = known.filter("h1 <> hub").select(F.col("key").alias("b_key"), *(F.col(c).alias(f"b_{c}") for c in ("h1", "size", "letters", "part")))
    # Of two indexed lines only one order is wanted; a longer line probes, so it isn't indexed under the same key.
    close = (F.col("key") == F.col("b_key")) & (F.col("a_part") != F.col("b_part")) & ((F.col("a_size") < F.col("b_size")) | (F.col("a_h1") < F.col("b_h1")))
    return a.join(b, close & alike(F.col("a_letters"), F.col("b_letters"), threshold)).select(F.col("a_h1").alias("a1"), F.col("b_h1").alias("b1")).distinct()


def _name(a: str, b: str) -> Column:
    return F.concat_ws(":", F.col(a), F.col(b))


def drops(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, key: str = "doc_id", text: str = "text", short: bool = False) -> DataFrame:
    """(doc, dropped, n_near): for documents that lose lines, their places (from 0, in order) and how many go that equal no other line."""
    lines = _lines(docs, min(1, min_chars) if short else min_chars, key, text)
    met = links(lines.filter(F.length("line") >= min_chars).select("h1", "line"), threshold)
    classes = components(met.select(_name("a1", "a2").alias("a"), _name("b1", "b2").alias("b")), kind="string")
    hashes = cut(lines.select("doc", "pos", "h1", "h2"), "line-hashes")
    counted = hashes.groupBy("h1", "h2").agg(F.min("doc").alias("first_doc"), F.count("*").alias("n")).withColumn("name", _name("h1", "h2"))
    tied = counted.join(classes, F.col("name") == F.col("node"), "left").filter("n > 1 OR node IS NOT NULL")
    tied = cut(tied.select("h1", "h2", "first_doc", "n", F.coalesce("component", "name").alias("class"), F.col("node").isNotNull().alias("linked")), "tied-lines")
    firsts = tied.filter("linked").groupBy("class").agg(F.min("first_doc").alias("class_doc")).withColumnRenamed("class", "c")
    tied = tied.join(firsts, F.col("class") == F.col("c"), "left").select("h1", "h2", "class", "n", "linked", F.coalesce("class_doc", "first_doc").alias("owner"))
    rows = cut(hashes.join(tied, ["h1", "h2"]).select("doc", "pos", "class", "owner", "n"), "tied-lines")
    other = rows.filter("doc <> owner")
    within = W.partitionBy("doc", "class")
    same = rows.filter("doc = owner").withColumn("first_pos", F.min("pos").over(within)).filter("pos > first_pos").drop("first_pos")
    gone = other.unionByName(same)
    return gone.groupBy("doc").agg(F.sort_array(F.collect_set("pos")).alias("dropped"), F.count(F.when(F.col("n") == 1, 1)).alias("n_near"))


def report(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, key: str = "doc_id", text: str = "text", short: bool = False) -> DataFrame:
    """Per document: n_lines, n_kept, n_near (dropped lines that equal no other) and the places of the dropped lines."""
    gone = drops(docs, threshold, min_chars, key, text, short)
    sizes = docs.select(F.col(key), F.size(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).cast("long").alias("n_lines"))
    out = sizes.join(gone, sizes[key].cast("long") == gone["doc"], "left")
    lost = F.coalesce(F.size("dropped"), F.lit(0)).cast("long")
    return out.select(
        key, "n_lines", (F.col("n_lines") - lost).alias("n_kept"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.coalesce(F.col("dropped"), F.array().cast("array<int>")).alias("dropped"),
    )


def apply(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, key: str = "doc_id", text: str = "text", short: bool = False) -> DataFrame:
    """The documents without the dropped lines, all columns kept; a document that loses lines and keeps nothing but white space goes."""
    doc, places = spare(docs, "doc"), spare(docs, "dropped")
    gone = drops(docs, threshold, min_chars, key, text, short).select(F.col("doc").alias(doc), F.col("dropped").alias(places))
    joined = docs.join(gone, F.col(key).cast("long") == F.col(doc), "left")
    kept = F.array_join(F.filter(F.split(F.col(text), "\n"), lambda x, i: ~F.array_contains(F.col(places), i)), "\n")
    changed = joined.withColumn(text, F.when(F.col(places).isNull(), F.col(text)).otherwise(kept))
    return changed.filter(F.col(places).isNull() | F.col(text).rlike(r"\S")).select(*docs.columns)
