"""Substring dedup: MinHash banding of paragraphs, exact Jaccard, removal by components; and passages inside paragraphs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import Forest, components, cut, drop, map_arrow, segments, shared_buckets, text_bytes, tiles
from llm.words import hashes, mix, shingles, spans, sums

SHINGLE = 5
JACCARD = 0.8
#: Rows of a band at least; fewer let too many unlike paragraphs meet.
ROWS = 3
#: Least probability that two paragraphs of Jaccard JACCARD share a band.
RECALL = 0.998
#: Lines of fewer words may be parts of a wrapped paragraph: they are compared alone and joined.
LINE = 20
#: Words of a passage, at least; every run of so many words that two documents share is found.
PASSAGE = 25
#: Words of an anchor; of the anchors in each PASSAGE words the one of the least hash is compared first.
ANCHOR = 8
#: Windows that are looked at together for their anchors.
AT_ONCE = 1 << 16
#: Members of a block of a bucket.
BLOCK = 256
#: Characters of text that are taken apart together.
TOGETHER = 1 << 20
#: What becomes of a part of a text: it stays, goes, or stays whatever else goes.
STAYS, GOES, SAVED = range(3)


def bands(least: float = JACCARD, recall: float = RECALL) -> tuple[int, int]:
    """(bands, rows) of the fewest hashes that give the recall at similarity ``least``, with ROWS rows at least."""
    choices = [(max(1, math.ceil(math.log(1 - recall) / math.log(1 - least**rows))), rows) for rows in range(ROWS, 9)]
    return min(choices, key=lambda c: c[0] * c[1])


class Texts:
    """Words of some texts side by side: byte spans, hashes, and the text each lies in."""

    def __init__(self, texts: list[str | None]):
        data = [text_bytes(t) for t in texts]
        self.data = b"\n".join(data)
        self.starts, self.ends = spans(self.data)
        self.hash = hashes(self.data, self.starts, self.ends)
        size = np.fromiter(map(len, data), dtype=np.int64, count=len(data)) + 1
        #: The first byte and the first word of each text, and where the last ends.
        self.bytes = np.concatenate([[0], np.cumsum(size)])
        self.words = np.searchsorted(self.starts, self.bytes)

    def owner(self, word: np.ndarray) -> np.ndarray:
        """The number of the text that each word lies in."""
        return np.searchsorted(self.words, word, side="right") - 1

    def paragraphs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and one past the last word of each line of SHINGLE words or more, and of each run of lines
        of under LINE words with no blank line between them; and the number of the run that a line is part of, or -1."""
        breaks = np.flatnonzero(np.frombuffer(self.data, dtype=np.uint8) == 0x0A)
        at = np.concatenate([[0], np.searchsorted(self.starts, breaks), [len(self.starts)]])
        first, last = at[:-1], at[1:]
        opens = np.isin(np.concatenate([[0], breaks + 1]), self.bytes)
        short = np.concatenate([[False], (last > first) & (last - first < LINE), [False]])
        begins = np.flatnonzero(short[1:-1] & (opens | ~short[:-2]))
        ends = np.flatnonzero(short[1:-1] & np.append(opens[1:] | ~short[2:-1], True))
        several = (ends > begins) & (last[ends] - first[begins] >= SHINGLE)
        begins, ends = begins[several], ends[several]
        change = np.zeros(len(first) + 1, dtype=np.int64)
        change[begins] += 1
        change[ends + 1] -= 1
        lines = np.flatnonzero(last - first >= SHINGLE)
        run = np.where(np.cumsum(change)[lines] > 0, np.searchsorted(begins, lines, side="right") - 1 + len(lines), -1)
        return np.concatenate([first[lines], first[begins]]), np.concatenate([last[lines], last[ends]]), np.append(run, np.full(len(begins), -1))

    def leasts(self) -> tuple[np.ndarray, np.ndarray]:
        """(first word, anchor) of each run of PASSAGE words of a text: the anchor is its run of ANCHOR words of the least hash."""
        order = shingles(self.hash, ANCHOR)
        number = len(self.hash) - PASSAGE + 1
        if number < 1:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        windows = np.lib.stride_tricks.sliding_window_view(order, PASSAGE - ANCHOR + 1)
        at = np.concatenate([a + windows[a : a + AT_ONCE].argmin(axis=1) + np.arange(min(AT_ONCE, number - a)) for a in range(0, number, AT_ONCE)])
        window = np.arange(number)
        whole = self.words[self.owner(window) + 1] - window >= PASSAGE
        return window[whole], at[whole]

    def keys(self, at: np.ndarray) -> np.ndarray:
        """The hashes of the anchors at the given words."""
        return shingles(self.hash, ANCHOR)[at].view(np.int64)

    def signatures(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """(paragraphs, bands): MinHash bands of the shingles of each run of words."""
        number, rows = bands()
        rng = np.random.default_rng(5)
        scale = rng.integers(1, 1 << 31, number * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        shift = rng.integers(0, 1 << 32, number * rows, dtype=np.uint32)
        grams = np.append((shingles(self.hash, SHINGLE) >> np.uint64(32)).astype(np.uint32), np.uint32(0))
        at = np.column_stack([first, last - SHINGLE + 1]).ravel()
        found = np.zeros((number, len(first)), dtype=np.uint64)
        for k in range(number * rows):
            value = (grams ^ shift[k]) * scale[k]
            low = np.minimum.reduceat(value ^ (value >> np.uint32(15)), at)[0::2]
            found[k // rows] = mix(found[k // rows] * np.uint64(31) + low + np.uint64(k // rows))
        return found.T


def _some(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, Texts]]:
    """(owners, texts) of rows (doc, text), about TOGETHER characters at a time."""
    for batch in batches:
        docs, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        a = 0
        while a < len(texts):
            b, size = a, 0
            while b < len(texts) and (b == a or size + len(texts[b] or "") <= TOGETHER):
                size += len(texts[b] or "")
                b += 1
            yield docs[a:b], Texts(texts[a:b])
            a = b


def _keyed(docs: DataFrame, ident: str, text: str) -> tuple[DataFrame, bool]:
    """(row, doc, text) with a number for each row, and whether it is other than the id.

    Where ids are there and don't repeat, they serve. Otherwise rows are numbered by id, then by a
    hash of the text, those without an id last, so that each row is a document of its own.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(whole, F.col(f"`{ident}`").cast("long").alias("doc"), F.col(f"`{text}`").cast("string").alias("text"))
    if not rows.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1 or doc is null").limit(1).count():
        return rows, False
    order = F.asc_nulls_last("doc"), F.xxhash64("text"), F.asc("tie")
    rows = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = cut(rows.select("row", F.monotonically_increasing_id().alias("doc")), "substring-rows")
    return rows.withColumn("text", F.col("row")[text].cast("string")), True


def _paragraphs(docs: DataFrame) -> DataFrame:
    """(key, doc, top, bands) of each paragraph; ``top`` is the document again, unless it is a line of a run of lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for owners, own in _some(batches):
            first, last, parent = own.paragraphs()
            if not len(first):
                continue
            found = own.signatures(first, last)
            held = pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1, dtype=np.int32) * found.shape[1]), pa.array(np.ascontiguousarray(found).view(np.int64).ravel()))
            doc = owners[own.owner(first)]
            columns = [pa.array(sums(own.hash, first, last).view(np.int64)), pa.array(doc), pa.array(doc, mask=parent >= 0), held]
            yield pa.record_batch(columns, names=["key", "doc", "top", "bands"])

    return map_arrow(docs, run, "key long, doc long, top long, bands array<long>")


def _places(docs: DataFrame) -> DataFrame:
    """(key, parent, doc, start, size, first, words) of each paragraph; ``parent`` is the key of the run of lines it is part of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for owners, own in _some(batches):
            first, last, parent = own.paragraphs()
            if not len(first):
                continue
            text, key = own.owner(first), sums(own.hash, first, last).view(np.int64)
            start, end = own.starts[first], own.ends[last - 1]
            columns = owners[text], start - own.bytes[text], end - start, first - own.words[text], last - first
            yield pa.record_batch([pa.array(key), pa.array(key[parent], mask=parent < 0), *(pa.array(x.astype(np.int64)) for x in columns)], names=["key", "parent", "doc", "start", "size", "first", "words"])

    return map_arrow(docs, run, "key long, parent long, doc long, start long, size long, first long, words long")


def _contents(docs: DataFrame, lines: DataFrame, members: DataFrame) -> DataFrame:
    """(key, grams): the sorted shingle hashes of the paragraphs in ``members``.

    Each is read from the first document that has it: keys and documents are joined by the document's
    id, at every size, so nothing that grows with the corpus is sent to all tasks.
    """
    keys = members.select(F.col("key").alias("_key")).distinct()
    wanted = lines.select("key", "low").join(keys, F.col("key") == F.col("_key"), "left_semi")
    wanted = wanted.groupBy(F.col("low").alias("_doc")).agg(F.collect_list("key").alias("keys"))
    rows = docs.join(wanted.hint("merge"), F.col("doc") == F.col("_doc")).select("doc", "text", "keys")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, at = batch.column(2).to_pylist(), 0
            for owners, own in _some([batch]):
                first, last, _ = own.paragraphs()
                key = sums(own.hash, first, last).view(np.int64)
                sought = [set(some) for some in lists[at : at + len(owners)]]
                at += len(owners)
                hits = np.array([k for k, (value, t) in enumerate(zip(key.tolist(), own.owner(first).tolist())) if value in sought[t]], dtype=np.int64)
                grams = shingles(own.hash, SHINGLE)
                held = [np.unique(grams[a:b]).tobytes() for a, b in zip(first[hits].tolist(), (last[hits] - SHINGLE + 1).tolist())]
                yield pa.record_batch([pa.array(key[hits]), pa.array(held, pa.binary())], names=["key", "grams"])

    return map_arrow(rows, fetch, "key long, grams binary").groupBy("key").agg(F.first("grams").alias("grams"))


def _similar(rows: DataFrame, least: float) -> DataFrame:
    """Edges (a, b) between paragraphs of a tile with Jaccard >= ``least`` that connect all such pairs of the tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in segments(batches, ["bucket", "tile_i", "tile_j"], 4000):
            keys = table["key"].to_pylist()
            sets = [np.frombuffer(g, dtype=np.uint64) for g in table["grams"].to_pylist()]
            a, b = [], []
            for s, e in zip(at[:-1].tolist(), at[1:].tolist()):
                forest = Forest(e - s)
                members: dict[int, list[int]] = {}
                for k in range(e - s):
                    # One link to each component is enough; a component is passed over only
                    # when none of its members is similar.
                    own = [k]
                    mine = set(sets[s + k].tolist())
                    for root in list(members):
                        for other in members[root]:
                            x, y = len(mine), len(sets[s + other])
                            if min(x, y) < least * max(x, y):
                                continue
                            both = len(mine.intersection(sets[s + other].tolist()))
                            if both >= least * (x + y - both):
                                forest.join(k, other)
                                a.append(keys[s + k])
                                b.append(keys[s + other])
                                own = members.pop(root) + own
                                break
                    members[forest.find(k)] = own
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return map_arrow(rows, run, "a long, b long", 2000)


def _passages(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """(key, doc, start, size, first, words, clean) of passages that cover all runs of PASSAGE words that documents share.

    Two documents that share PASSAGE words share the anchor of these, so no shared run is missed. The
    runs of one anchor lie side by side in a text. Where they are the same words in all documents that
    have the anchor, they are one passage; elsewhere each run is one. A passage is clean if it overlaps
    none of the paragraphs ``gone`` (_gone, spans) from its document. Runs that lie in paragraphs whose
    own words stay elsewhere need no row.
    """

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for owners, own in _some(batches):
            at = np.unique(own.leasts()[1])
            yield pa.record_batch([pa.array(own.keys(at)), pa.array(owners[own.owner(at)])], names=["key", "doc"])

    rows = anchored = cut(map_arrow(docs, anchors, "key long, doc long"), "substring-anchor-places")
    shared = rows.groupBy("key").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select(F.col("key").alias("_key"))
    # Joins by a passage's words are between scratch tables: adaptive execution can then split a common one.
    shared = cut(shared, "substring-anchors")
    wanted = rows.join(shared.hint("merge"), F.col("key") == F.col("_key"), "left_semi")
    wanted = wanted.groupBy(F.col("doc").alias("_doc")).agg(F.collect_set("key").alias("keys"))
    wanted = wanted.join(gone, F.col("_doc") == F.col("_gone"), "left").select("_doc", "keys", "spans")

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, spans, row = batch.column(2), batch.column(3).to_pylist(), 0
            for owners, own in _some([batch]):
                yield _runs(own, owners, [lists[row + k].values.to_numpy() for k in range(len(owners))], spans[row : row + len(owners)])
                row += len(owners)

    rows = docs.join(wanted.hint("merge"), F.col("doc") == F.col("_doc")).select("doc", "text", "keys", "spans")
    rows = cut(map_arrow(rows, around, "anchor long, whole long, doc long, start long, size long, first long, words long, clean boolean, parted boolean, runs array<long>"), "substring-runs")
    drop(anchored, shared)
    runs = rows
    even = (F.min("whole") == F.max("whole")) & ~F.max("parted")
    shared = rows.groupBy(F.col("anchor").alias("_anchor")).agg(F.min("doc").alias("low"), F.max("doc").alias("high"), even.alias("even")).where("low < high")
    rows = rows.join(cut(shared.select("_anchor", "even"), "substring-even").hint("merge"), F.col("anchor") == F.col("_anchor"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one = batch.filter(batch.column(9))
            yield pa.record_batch([one.column(k) for k in (0, 1, 2, 3, 4, 5, 6)], names=SPREAD)
            many = batch.filter(pc.invert(batch.column(9)))
            pairs = many.column(8).flatten().to_numpy().reshape(-1, 2)
            number = many.column(8).value_lengths().to_numpy() // 2
            of = np.repeat(np.arange(many.num_rows), number)
            place, step = pairs[:, 1], np.arange(len(of)) - np.repeat(np.cumsum(number) - number, number)
            doc, start, first = (many.column(k).to_numpy()[of] for k in (1, 2, 4))
            columns = pairs[:, 0], doc, start + (place >> 33), (place >> 2) & 0x7FFFFFFF, first + step, np.full(len(of), PASSAGE)
            keep = place & 2 == 0
            yield pa.record_batch([*(pa.array(c[keep].astype(np.int64)) for c in columns), pa.array((place & 1 == 1)[keep])], names=SPREAD)

    rows = rows.select("whole", "doc", "start", "size", "first", "words", "clean", "anchor", "runs", "even")
    found = cut(map_arrow(rows, spread, "key long, doc long, start long, size long, first long, words long, clean boolean"), "substring-passages")
    drop(runs)
    return found


SPREAD = ["key", "doc", "start", "size", "first", "words", "clean"]


def _runs(own: Texts, owners: np.ndarray, keys: list[np.ndarray], spans: list[list[dict] | None]) -> pa.RecordBatch:
    """The runs of PASSAGE words of each wanted anchor, side by side.

    ``whole`` digests the words they cover; ``runs`` has each run's digest and its place: byte after
    the first run's start, size, whether its words stay elsewhere (so it needs no row), and whether it is clean.
    """
    first, at = own.leasts()
    text = own.owner(first)
    edge, key = np.searchsorted(text, np.arange(len(owners) + 1)), own.keys(at)
    wanted = np.zeros(len(first), dtype=bool)
    gone, copied = np.zeros((2, len(own.hash) + 1), dtype=np.int64)
    for k, (word, a, b) in enumerate(zip(own.words[:-1].tolist(), edge[:-1].tolist(), edge[1:].tolist())):
        wanted[a:b] = np.isin(key[a:b], keys[k])
        for span in spans[k] or ():
            for change in (gone, copied)[: 1 + span["exact"]]:
                change[word + span["first"]] += 1
                change[word + span["last"]] -= 1
    gone, copied = (np.concatenate([[0], np.cumsum(np.cumsum(change) > 0)]) for change in (gone, copied))
    needless = copied[first + PASSAGE] - copied[first] == PASSAGE
    clean = gone[first + PASSAGE] == gone[first]
    begins = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])])) if len(first) else np.zeros(0, dtype=np.int64)
    number = np.diff(np.append(begins, len(first)))
    kept = wanted[begins] & (np.add.reduceat(~needless, begins) > 0) if len(first) else np.zeros(0, dtype=bool)
    begins, number, some = begins[kept], number[kept], np.repeat(kept, number)
    a, b = first[begins], first[begins] + number - 1 + PASSAGE
    start, end, lost = own.starts[a], own.ends[b - 1], gone[b] - gone[a]
    first, clean, needless = first[some], clean[some], needless[some]
    place = own.starts[first] - np.repeat(start, number) << 33 | own.ends[first + PASSAGE - 1] - own.starts[first] << 2 | needless.astype(np.int64) << 1 | clean
    runs = np.column_stack([shingles(own.hash, PASSAGE)[first].view(np.int64) if len(first) else first, place]).ravel()
    held = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(2 * number)]).astype(np.int32)), pa.array(runs.astype(np.int64)))
    text = own.owner(a)
    columns = own.keys(a)[:0] if not len(a) else own.keys(at[begins]), sums(own.hash, a, b).view(np.int64), owners[text], start - own.bytes[text], end - start, a - own.words[text], b - a
    columns = [pa.array(c.astype(np.int64)) for c in columns]
    return pa.record_batch([*columns, pa.array(lost == 0), pa.array((lost > 0) & (lost < b - a)), held], names=["anchor", "whole", "doc", "start", "size", "first", "words", "clean", "parted", "runs"])


def _decided(rows: DataFrame, owner: str) -> DataFrame:
    """Parts with what becomes of them: clean ones stay in the document ``owner`` and go from others.

    Without an owner, as none is clean, that of the document ``low`` is saved from what goes there.
    """
    stays = F.when(F.col("doc") == F.col(owner), STAYS).otherwise(GOES)
    kind = F.when(F.col(owner).isNull(), F.when(F.col("doc") == F.col("low"), SAVED)).otherwise(F.when(F.col("clean"), stays))
    end, last = F.col("start") + F.col("size"), F.col("first") + F.col("words")
    return rows.select("doc", "start", end.alias("end"), "first", last.alias("last"), F.coalesce(owner, "low").alias("low"), kind.alias("kind"), "exact").where("kind is not null")


def _parts(docs: DataFrame, least: float) -> DataFrame:
    """(doc, start, end, n_words, first_doc, removed) of rows (doc, text), each with its own doc.

    Paragraphs first, lines of runs next, exact passages last; at each step what has gone before
    doesn't count as a copy, so that of all that goes a copy stays.
    """
    lines = _paragraphs(docs).groupBy("key").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.min("top").alias("top"), F.first("bands").alias("bands"))
    lines = cut(lines, "substring-lines")
    members = shared_buckets(lines.select(F.explode("bands").alias("bucket"), "key"), "bucket", "substring-buckets")
    edges = _similar(tiles(members.join(_contents(docs, lines, members), "key"), "bucket", "key", BLOCK), least)
    roots = components(edges, "substring-cc")
    drop(members)
    repeated = (F.col("low") < F.col("high")).alias("repeated")
    owned = cut(lines.join(roots, F.col("key") == F.col("node"), "left").select("key", F.coalesce("root", "key").alias("root"), "low", "high", "top", repeated), "substring-owner")
    group = owned.groupBy(F.col("root").alias("_root")).agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("top").alias("top")).where("low < high").drop("high")
    drop(lines)
    flagged = owned.select("key", "root", "repeated", F.col("top").alias("_own")).join(group, F.col("root") == F.col("_root"))
    flagged = cut(flagged.select("key", "root", "low", "top", "repeated", F.coalesce(F.col("_own") == F.col("top"), F.lit(False)).alias("exact")), "substring-flagged")

    places = cut(_places(docs).join(flagged.withColumnRenamed("key", "_key").hint("merge"), F.col("key") == F.col("_key")).drop("_key", "key"), "substring-places")
    whole = places.where("parent is null").withColumn("clean", F.lit(True))
    above = flagged.select(F.col("key").alias("_key"), F.col("top").alias("_top"), F.col("repeated").alias("_repeated"))
    inner = places.where("parent is not null").join(above.hint("merge"), F.col("parent") == F.col("_key"), "left")
    inner = inner.withColumn("clean", F.coalesce(F.col("_top") == F.col("doc"), F.lit(True)))
    # A run that stays as the copy of others keeps its lines, but for those that stay elsewhere word for word.
    inner = cut(inner.where("exact or not clean or not coalesce(_repeated, false)").drop("_key", "_top", "_repeated"), "substring-inner")
    owner = inner.where("top is null").groupBy(F.col("root").alias("_root")).agg(F.min(F.when(F.col("clean"), F.col("doc"))).alias("own"))
    lines_of_runs = inner.join(owner, F.col("root") == F.col("_root"), "left").withColumn("own", F.coalesce("top", "own"))
    known = cut(_decided(whole, "top").unionAll(_decided(lines_of_runs, "own")), "substring-known")
    drop(owned, flagged, places, inner)

    gone = known.where(F.col("kind") == GOES).groupBy(F.col("doc").alias("_gone")).agg(F.collect_list(F.struct("first", "last", "exact")).alias("spans"))
    passages = _passages(docs, gone)
    short = passages.groupBy(F.col("key").alias("_key")).agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.min(F.when(F.col("clean"), F.col("doc"))).alias("own")).where("low < high")
    rows = passages.join(cut(short.drop("high"), "substring-shared").hint("merge"), F.col("key") == F.col("_key")).withColumn("exact", F.lit(True))
    rows = known.unionAll(_decided(rows, "own")).repartition("doc").drop("exact").sortWithinPartitions("doc", "first", "last")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _ in segments(batches, ["doc"]):
            yield _union(*(table[c].to_numpy() for c in ("doc", "start", "end", "first", "last", "low", "kind")))

    return map_arrow(rows, merge, "doc long, start long, end long, n_words long, first_doc long, removed boolean", 5000)


def repeats(docs: DataFrame, ident: str = "doc_id", text: str = "text", least: float = JACCARD) -> DataFrame:
    """(ident, start, end, n_words, removed, first_doc): passages of each text that other rows have too.

    Compared are lines of SHINGLE words or more and runs of short lines, which a wrapped paragraph is, by MinHash bands and exact Jaccard of word
    5-shingles, and all runs of PASSAGE words, by their content, so that a repeated passage of so many
    words or more is found from its first word to its last, wherever it stands in its lines.
    Similar paragraphs are one class by components. What two rows or more have stays in one of them,
    that of the smallest id (``first_doc``) among those where it is no part of something larger that
    goes, and is removed from the others; if it is such a part everywhere, it stays in that of the
    smallest id all the same. So every word of a repeated passage stays somewhere. Overlapping passages of a row
    are merged; start and end are bytes of its UTF-8 text. Each row is a document: rows may repeat an
    id or have none, which count as the largest; equal rows are copies of each other. Null, empty and unrepeated texts give no rows. Ids are whole numbers.
    """
    rows, numbered = _keyed(docs, ident, text)
    found = _parts(rows.select("doc", "text"), least)
    if not numbered:
        return found.select(F.col("doc").alias(ident), "start", "end", "n_words", "removed", "first_doc")
    names = rows.select(F.col("doc").alias("_doc"), F.col("row")[ident].cast("long").alias("_name"))
    found = found.join(names, F.col("doc") == F.col("_doc")).withColumn("doc", F.col("_name")).drop("_doc", "_name")
    found = found.join(names, F.col("first_doc") == F.col("_doc")).withColumn("first_doc", F.col("_name"))
    return found.select(F.col("doc").alias(ident), "start", "end", "n_words", "removed", "first_doc")


def _merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, last: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, ...]:
    """Parts of a document that overlap or touch, as one, with the smallest first document; sorted by doc and first."""
    if not len(doc):
        return doc, start, end, first, last, low
    group = np.concatenate([[0], np.cumsum(doc[1:] != doc[:-1])])
    # The farthest word so far, within the group: groups are set apart by more than any word's number.
    apart = group * (last.max() + 1)
    reach = np.maximum.accumulate(last + apart)
    at = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (first[1:] + apart[1:] > reach[:-1])]))
    return doc[at], start[at], np.maximum.reduceat(end, at), first[at], np.maximum.reduceat(last, at), np.minimum.reduceat(low, at)


def _less(gone: tuple[np.ndarray, ...], saved: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """The parts ``gone`` without the words of the parts ``saved``, each merged and sorted."""
    spared: dict[int, list[tuple[int, ...]]] = {}
    for row in zip(*(c.tolist() for c in saved)):
        spared.setdefault(row[0], []).append(row)
    rows = []
    for doc, start, end, first, last, low in zip(*(c.tolist() for c in gone)):
        for _, left, right, a, b, _ in spared.get(doc, ()):
            if b <= first or a >= last:
                continue
            if a > first:
                rows.append((doc, start, left, first, a, low))
            start, first = right + 1, b  # a byte of white space parts words
        if first < last:
            rows.append((doc, start, end, first, last, low))
    return tuple(np.array(c, dtype=np.int64) for c in zip(*rows)) if rows else tuple(c[:0] for c in gone)


def _union(doc: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, last: np.ndarray, low: np.ndarray, kind: np.ndarray) -> pa.RecordBatch:
    """What goes from each document and what stays, merged; rows are sorted by doc, first and last."""
    parts = lambda some: _merged(*(x[some] for x in (doc, start, end, first, last, low)))
    stays, gone = parts(kind != GOES), parts(kind == GOES)
    if (kind == SAVED).any():
        gone = _less(gone, parts(kind == SAVED))
    both = [np.concatenate(pair) for pair in zip(stays, gone)]
    removed = np.arange(len(both[0])) >= len(stays[0])
    columns = both[0], both[1], both[2], both[4] - both[3], both[5], removed
    return pa.record_batch([pa.array(c) for c in columns], names=["doc", "start", "end", "n_words", "first_doc", "removed"])


def without(text: str, parts: list[tuple[int, int]]) -> str:
    """``text`` without the byte spans, and without the white space that followed them."""
    data, at, kept = text.encode("utf-8", "surrogatepass"), 0, []
    for start, end in sorted(parts):
        kept.append(data[at:start])
        at = end
        while at < len(data) and data[at] in b" \t\n\r\v\f":
            at += 1
    return b"".join([*kept, data[at:]]).decode("utf-8", "surrogatepass")


def remove_repeats(docs: DataFrame, ident: str = "doc_id", text: str = "text", least: float = JACCARD) -> DataFrame:
    """``docs`` with repeated passages cut out of their texts; a row of which no word is left goes.

    Every row is cut by its own passages, whatever its id; nulls, empty texts and other columns stay.
    """
    rows, _ = _keyed(docs, ident, text)
    gone = _parts(rows.select("doc", "text"), least).where("removed").groupBy(F.col("doc").alias("_doc")).agg(F.collect_list(F.struct("start", "end")).alias("_parts"))
    gone = cut(gone, "substring-gone")
    names = docs.columns
    rows = rows.select("row", "doc").join(gone.hint("merge"), F.col("doc") == F.col("_doc"), "left").select("row", "_parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(0)
            column = row.type.get_field_index(text)
            texts = row.field(column).to_pylist()
            keep = np.ones(len(texts), dtype=bool)
            for k, parts in enumerate(batch.column(1).to_pylist()):
                if parts and texts[k] is not None:
                    texts[k] = without(texts[k], [(p["start"], p["end"]) for p in parts])
                    keep[k] = bool(texts[k].encode("utf-8", "surrogatepass").split())
            fields = [pa.array(texts, row.type[column].type) if i == column else row.field(i) for i in range(row.type.num_fields)]
            yield pa.record_batch(fields, names=names).filter(pa.array(keep))

    return map_arrow(rows, run, docs.schema)
