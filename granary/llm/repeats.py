"""Suffix-array dedup: finds every string of LENGTH bytes that starts earlier in the corpus, and removes what it covers.

1. Anchors. The anchor of a window of LENGTH bytes is its k-gram of least hash, and follows from the window's bytes alone;
   equal windows have equal anchors. Windows that start next to each other mostly share their anchor, and such a run of
   windows is a segment of LENGTH to LENGTH + 76 bytes. A run that holds its anchor several times (runs of one letter, rulers,
   tables) may repeat itself, however short it is; windows of it that repeat what starts earlier in it are known as
   repeats at once. Anchors that occur once in the corpus have no other repeated windows.
2. Segments of the other anchors are gathered by their bytes: equal segments become one, with the place of the first,
   in the map-side part of an aggregation, so a passage of very many copies arrives as one row from each task.
3. A segment that alone has its anchor is the first of its kind. Those that share an anchor but differ (the ends of a
   passage) meet in groups of about a megabyte. A
   Burrows-Wheeler transform of a group is searched breadth first by backward extension, common prefixes come by
   increasing value up to LENGTH, and windows between which no shorter one lies are equal; the first of them stays.
   Anchors with many different segments (a common line) have their windows dealt by hash over the cluster instead.
4. Each document gets the ranges of windows that are the first of their kind. Every other window of its repeated
   anchors is removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.bwt import equal_windows
from granary.llm.common import free, id_text, kept_table, map_runs, whole
from granary.llm.shingles import _BASE, _BYTE, _powers, mix

LENGTH, GRAM = 100, 24
#: Different segments of one anchor that are searched together, at most; bytes of a group; windows of a block of a long text; bytes
#: of short texts hashed together, few enough for a core's cache.
MOST_SEGMENTS, GROUP_BYTES, CHUNK, TOGETHER = 64, 700_000, 1 << 20, 1 << 17
LAST_ID = (1 << 63) - 1
#: Windows of a segment at most, where its anchor comes again and again.
LONGEST = 512

_power_table: list[np.ndarray] = []


def _gram_hashes(buf: np.ndarray, k: int) -> np.ndarray:
    if not _power_table or len(_power_table[0]) <= len(buf):
        _power_table[:] = _powers(max(len(buf), 2 * CHUNK))
    up, down = _power_table
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[buf] * up[: len(buf)])])
    return mix((sums[k:] - sums[:-k]) * down[: len(buf) - k + 1])


Found = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def segments(texts: list[bytes], length: int = LENGTH, k: int = GRAM) -> Iterator[Found]:
    """For each text, in order: (hash of the anchor, first window, last window) of its segments as three arrays, and the
    (first, last) windows of stretches that repeat what starts a period earlier.

    Short texts are worked on together, long ones in blocks, so the arrays in between are bounded.
    """
    held: list[bytes] = []
    size = 0
    for t in texts:
        if len(t) > 2 * CHUNK:
            yield from _segments(held, length, k)
            held, size = [], 0
            yield _joined([_segments_at(t, a, min(a + CHUNK, len(t) - length + 1), length, k) for a in range(0, len(t) - length + 1, CHUNK)])
            continue
        held.append(t)
        size += len(t)
        if size >= TOGETHER:
            yield from _segments(held, length, k)
            held, size = [], 0
    yield from _segments(held, length, k)


def _segments_at(text: bytes, start: int, end: int, length: int, k: int) -> Found:
    """Segments of a text's windows from start to before end."""
    (h, first, last, inner), *_ = _segments([text[start : end + length - 1]], length, k)
    return h, first + start, last + start, inner + start


def _joined(parts: list[Found]) -> Found:
    return tuple(np.concatenate(x) for x in zip(*parts))


def _segments(texts: list[bytes], length: int, k: int) -> Iterator[Found]:
    none = np.zeros(0, np.int64)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    buf = np.frombuffer(b"".join(texts), np.uint8)
    if len(buf) < length:
        yield from ((none, none, none, none.reshape(0, 2)) for _ in texts)
        return
    grams = least = _gram_hashes(buf, k)
    width, wanted = 1, length - k + 1
    while width < wanted:  # least hash of `width` grams
        step = min(width, wanted - width)
        least = np.minimum(least[step:], least[:-step])
        width += step
    # Windows that cross from one text to the next don't count.
    inside = np.zeros(len(least) + 1, np.int32)
    have = sizes >= length
    np.add.at(inside, begins[have], 1)
    np.add.at(inside, ends[have] - length + 1, -1)
    inside = np.cumsum(inside[:-1]) > 0
    opens = inside.copy()
    opens[1:] &= (least[1:] != least[:-1]) | ~inside[:-1]
    opens[begins[have]] = True
    shuts = inside.copy()
    shuts[:-1] &= opens[1:] | ~inside[1:]
    first, last = np.flatnonzero(opens), np.flatnonzero(shuts)
    hashes = least[first].view(np.int64)
    inner = none.reshape(0, 2)
    # Where a window begins with its anchor and the next one has the same, the anchor comes again within the segment.
    same = (grams[: len(least) - 1] == least[:-1]) & inside[1:] & ~opens[1:]
    looped = np.unique(np.searchsorted(first, np.flatnonzero(same), "right")) - 1
    if len(looped):
        parts = [_looped(buf, grams, int(first[i]), int(last[i]), length, wanted) for i in looped]
        rest = np.ones(len(first), bool)
        rest[looped] = False
        first = np.concatenate([first[rest], *(p[0][:, 0] for p in parts)])
        last = np.concatenate([last[rest], *(p[0][:, 1] for p in parts)])
        hashes = np.concatenate([hashes[rest], *(np.full(len(p[0]), hashes[i]) for i, p in zip(looped, parts))])
        order = np.argsort(first, kind="stable")
        first, last, hashes = first[order], last[order], hashes[order]
        inner = np.concatenate([p[1] for p in parts])
    bounds = np.concatenate([begins, ends[-1:]])
    cut, within = np.searchsorted(first, bounds), np.searchsorted(inner[:, 0], bounds)
    for a, b, c, d, begin in zip(cut[:-1], cut[1:], within[:-1], within[1:], begins):
        yield hashes[a:b], first[a:b] - begin, last[a:b] - begin, inner[c:d] - begin


def _looped(buf: np.ndarray, grams: np.ndarray, first: int, last: int, length: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Two lists of (first, last) windows of a run that holds its anchor several times: segments, and stretches of repeats.

    The period tried first is the commonest distance of the anchor's places; windows that repeat others of the run at
    another distance are found by their hashes and compared by their bytes. So no window of the segments repeats
    another of the run. Segments are cut at LONGEST windows.
    """
    inside = grams[first : last + wanted]
    steps = np.diff(np.flatnonzero(inside == inside.min()))
    period = int(np.bincount(steps).argmax())
    differs = np.concatenate([[0], np.cumsum(buf[first + period : last + length] != buf[first : last + length - period])])
    repeats = np.zeros(last - first + 1, bool)
    if len(differs) > length:
        repeats[period:] = differs[length:] == differs[:-length]
    left = np.flatnonzero(~repeats)
    if len(steps) > 1 and left[-1] - left[0] >= steps.min():  # else no windows are left that stand at another distance
        _, lead, kind = np.unique(_gram_hashes(buf[first : last + length], length)[left], return_index=True, return_inverse=True)
        before = left[lead[kind]]
        windows = np.lib.stride_tricks.sliding_window_view(buf[first : last + length], length)
        again = np.flatnonzero(before < left)
        for at in range(0, len(again), 4096):
            some = again[at : at + 4096]
            repeats[left[some]] = (windows[left[some]] == windows[before[some]]).all(1)
    edge = np.flatnonzero(np.concatenate([[True], repeats[1:] != repeats[:-1], [True]]))
    spans = np.stack([edge[:-1], edge[1:] - 1], 1) + first
    again = repeats[edge[:-1]]
    own = [(a, min(a + LONGEST, z + 1) - 1) for x, z in spans[~again].tolist() for a in range(x, z + 1, LONGEST)]
    return np.array(own, np.int64).reshape(-1, 2), spans[again]


def search_group(rows: list[tuple], length: int) -> list[tuple]:
    """(doc, t, first, last) ranges of windows that are the first of their kind, from rows (h, seg, doc, t, pos)."""
    rows = sorted(rows, key=lambda r: r[2:])
    text, start, group = equal_windows([r[1] for r in rows], length)
    docs, keys, places = (np.array([r[i] for r in rows], np.int64) for i in (2, 3, 4))
    doc, key, place = docs[text], keys[text], places[text] + start
    lead = np.full(int(group.max(initial=-1)) + 1, -1)
    lead[group[::-1]] = np.arange(len(group))[::-1]  # of windows of one group the first is written last
    first = lead[group] == np.arange(len(group))
    edge = np.ones(len(first) + 1, bool)  # windows are in order of text and start
    edge[1:-1] = (first[1:] != first[:-1]) | (text[1:] != text[:-1])
    cut = np.flatnonzero(edge)
    return [(int(doc[a]), int(key[a]), int(place[a]), int(place[b - 1])) for a, b in zip(cut[:-1], cut[1:]) if first[a]]


def _spans(found: Found, repeated: np.ndarray | None, keep: np.ndarray | list, size: int, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that a removed window covers. keep: (first, last) windows inside the repeated segments."""
    h, first, last, inner = found
    hit = np.isin(h, repeated) if repeated is not None else np.zeros(len(h), bool)
    keep = np.asarray(keep, np.int64).reshape(-1, 2)
    windows = np.zeros(size + 2, np.int8)  # a window is in one segment or stretch, and in one range that is kept
    np.add.at(windows, np.concatenate([first[hit], inner[:, 0], keep[:, 1] + 1]), 1)
    np.add.at(windows, np.concatenate([last[hit] + 1, inner[:, 1] + 1, keep[:, 0]]), -1)
    gone = np.cumsum(windows[:-1], dtype=np.int8).astype(bool)
    edge = np.flatnonzero(gone[1:] != gone[:-1]) + 1
    edge = np.concatenate([[0], edge]) if gone[0] else edge
    spans: list[list[int]] = []
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = b - 1 + length
        else:
            spans.append([a, b - 1 + length])
    return [(a, b) for a, b in spans]


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, spans (array of start, end: the maximal removed runs), kept (binary).

    A text is its UTF-8 bytes, null counts as empty. A byte is removed if a string of `length` bytes that covers it
    also starts earlier: in a document of smaller id, or further ahead in the same one. Strings are judged on the input
    and never cross documents. Documents without an id come last, and rows that share an id, or have none, in order of
    a hash of their text; rows that repeat an id and text are one document, and have the same result. Very long texts
    are worked on in blocks. Other columns are ignored, and an empty table gives an empty result. Anchors are compared
    by 64-bit hashes; the strings themselves by their bytes, or, of anchors with very many different surroundings, by
    128-bit hashes.
    """
    gram = min(GRAM, max(1, length // 4))
    key = ["doc", "t"]
    rows = docs.select(id_text(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST_ID)).alias("doc"), whole(text_col).cast("binary").alias("b"))
    rows = rows.withColumn("t", F.xxhash64("b", F.col("doc_id").isNull()))
    able = rows.filter(F.octet_length("b") >= length)

    def anchors(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({"doc": p["doc"], "t": p["t"], "h": [h for h, *_ in segments(p["b"], length, gram)]})

    all_anchors = able.select(*key, "b").mapInPandas(anchors, "doc bigint, t bigint, h array<bigint>").select(*key, F.explode("h").alias("h"))
    repeated = kept_table(all_anchors.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("h"), "repeats-anchors")
    per_doc = kept_table(all_anchors.join(repeated, "h").groupBy(*key).agg(F.collect_set("h").alias("hs")), "repeats-documents")
    free(repeated)

    def gather(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def table() -> pd.DataFrame:
            of = np.repeat(np.arange(len(ids)), [len(x) for x in hashes])
            doc, t = np.array(ids, np.int64).reshape(-1, 2)[of].T
            none = [np.zeros(0, np.int64)]
            return pd.DataFrame({"h": np.concatenate(hashes or none), "seg": segs, "doc": doc, "t": t, "pos": np.concatenate(starts or none)})

        for p in parts:
            ids, hashes, starts, segs = [], [], [], []
            for doc, t, b, hs, (h, first, last, _) in zip(p["doc"], p["t"], p["b"], p["hs"], segments(p["b"], length, gram)):
                hit = np.isin(h, hs)
                h, first, last = h[hit], first[hit], last[hit]
                for at in range(0, len(h), 20_000):
                    some = slice(at, at + 20_000)
                    ids.append((doc, t))
                    hashes.append(h[some])
                    starts.append(first[some])
                    segs.extend([b[i : j + length] for i, j in zip(first[some].tolist(), last[some].tolist())])
                    if len(segs) > 20_000:
                        yield table()
                        ids, hashes, starts, segs = [], [], [], []
            yield table()

    places = able.select(*key, "b").join(per_doc, key).mapInPandas(gather, "h bigint, seg binary, doc bigint, t bigint, pos bigint")
    firsts = places.groupBy("h", "seg").agg(F.min(F.struct("doc", "t", "pos")).alias("p"))
    firsts = kept_table(firsts.select("h", "seg", "p.doc", "p.t", "p.pos"), "repeats-segments")
    keep = kept_table(_firsts(firsts, length).groupBy(*key).agg(F.collect_list(F.shiftleft("first", 32) + F.col("last")).alias("keep")), "repeats-kept")
    free(firsts)

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for at in range(0, len(p), 500):
                some = p.iloc[at : at + 500]
                spans, left = [], []
                for b, hs, keep_, found in zip(some["b"], some["hs"], some["keep"], segments(some["b"], length, gram)):
                    ranges = np.stack([keep_ >> 32, keep_ & 0xFFFFFFFF], 1) if keep_ is not None else []  # a text is below 2 GB
                    s = _spans(found, hs, ranges, len(b), length) if hs is not None or len(found[3]) else []
                    spans.append([{"start": x, "end": y} for x, y in s])
                    ends = [0, *(v for x in s for v in x), len(b)]
                    left.append(b"".join(b[x:y] for x, y in zip(ends[::2], ends[1::2])) if s else b)
                yield pd.DataFrame({"doc_id": some["doc_id"], "n_bytes": [len(b) for b in some["b"]], "spans": spans, "kept": left})

    kind = docs.select(F.col(id_col).alias("doc_id")).schema["doc_id"].dataType
    facts = per_doc.join(keep, key, "left")
    done = rows.join(facts, key, "left").select("doc_id", "b", "hs", "keep").mapInPandas(cut, "doc_id string, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")
    return done.withColumn("doc_id", F.col("doc_id").cast(kind))


def _firsts(segs: DataFrame, length: int) -> DataFrame:
    """(doc, t, first, last) ranges of windows that are the first of their kind, from distinct segments and their places."""
    many = kept_table(segs.groupBy("h").count().filter(F.col("count") > MOST_SEGMENTS).select("h"), "repeats-many")
    total = segs.agg(F.sum(F.octet_length("seg").cast("bigint")).alias("n")).first()["n"] or 0
    few = segs.join(many, "h", "left_anti").withColumn("group", F.pmod(F.xxhash64("h"), F.lit(total // GROUP_BYTES + 1))).repartition("group")
    few = few.withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("group", "h")))
    alone = few.filter("c = 1").select("doc", "t", F.col("pos").alias("first"), (F.col("pos") + F.octet_length("seg") - length).alias("last"))
    several = few.filter("c > 1").select("group", "h", "seg", "doc", "t", "pos")
    found = map_runs(several, ["group"], [], lambda g: search_group(g, length), "doc bigint, t bigint, first bigint, last bigint", dealt=True)
    starts = F.sequence(F.lit(0), F.octet_length("seg") - length)
    windows = segs.join(many, "h", "left_semi").select("doc", "t", "pos", "seg", F.explode(starts).alias("i"))
    windows = windows.select(F.unhex(F.md5(F.substring("seg", F.col("i") + 1, F.lit(length)))).alias("w"), F.struct("doc", "t", (F.col("pos") + F.col("i")).alias("at")).alias("p"))
    spread = windows.groupBy("w").agg(F.min("p").alias("p")).select("p.doc", "p.t", F.col("p.at").alias("first"), F.col("p.at").alias("last"))
    return alone.unionByName(found).unionByName(spread)
