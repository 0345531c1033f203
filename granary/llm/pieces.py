"""SentencePiece encoding and decoding by streaming Viterbi.

The best segmentation of a text into pieces maximises the sum of their scores. Best sums and backpointers are held for
a window of boundaries, as wide as the longest piece; what lies before the boundary on which all surviving paths agree
is final, and its ids are committed. The window is all that a text of any length needs.

A boundary that no piece spans (a word's start, as no piece has a space mark after another character, or two characters
that stand side by side in no piece) is on every path, so the stream commits there without following backpointers. The
ids between two commits depend on the characters between them alone; those of short stretches are kept in a bounded
table in each worker. Stream(codec, known_boundaries=False) does without both, and finds the same segmentation.

Scores: a unigram model's own. A BPE model has ranks in place of probabilities; its pieces are scored by Zipf's law,
-log(rank + 2), so the segmentation is the likeliest under that law and not the sequence of merges. Characters that are
no piece are spelt as bytes. A space mark that stands in the text itself is spelt as bytes too, so that decoding gives
back the very text; the library's own decoder reads the ids in the same way.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from math import log
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import id_text, kept_here, whole

SPACE = "▁"
#: Characters of a word whose ids are kept, and the memory for these in each worker, about.
KEEP_LENGTH, KEEP_BYTES = 24, 130_000_000
#: Texts encoded at a time, which bounds the lists of ids that are alive together.
SOME = 200
#: A byte piece costs as much as a very rare piece, so bytes spell only what nothing else does.
BYTE_COST = 20.0


class Stream:
    """Viterbi over text that arrives in parts; committed ids gather in `ids`.

    Held are the text since the last commit, and for each boundary in it the best sum and where its last piece starts.
    """

    def __init__(self, codec: PieceCodec, known_boundaries: bool = True):
        self.codec, self.known_boundaries = codec, known_boundaries
        self.ids: list[int] = []
        self.commits = 0
        self.text = ""
        self.best, self.back = [0.0], [0]
        self.tried = 0  # characters that the last commit left

    def feed(self, part: str) -> None:
        """The next characters, with space marks for spaces."""
        if not self.known_boundaries:
            self._through_window(part)
            return
        c, at = self.codec, 0
        for i in range(1 if self.text == "" else 0, len(part)):
            before = part[i - 1] if i else self.text[-1]
            if before + part[i] not in c.pairs:
                self._meet(part[at:i])
                at = i
        self._through_window(part[at:])

    def _meet(self, part: str) -> None:
        """Commits all text up to the end of part, a boundary that every path has."""
        if part:
            self._through_window(part)
        if self.text:
            self._settle(len(self.text))
            self.commits += 1
            self.text, self.best, self.back, self.tried = "", [0.0], [0], 0

    def _through_window(self, part: str) -> None:
        at, room = 0, 4 * self.codec.longest
        while at < len(part):
            # Paths of a long run of one character may not meet; ever larger steps keep the attempts few.
            step = max(room, len(self.text) // 2)
            self._advance(part[at : at + step])
            at += step
            if len(self.text) > self.tried + room + self.tried // 2:
                self._commit()
                self.tried = len(self.text)

    def _advance(self, part: str) -> None:
        c = self.codec
        score, best, back = c.score_of_ending.get, self.best, self.back
        text = self.text = self.text + part
        for end in range(len(best), len(text) + 1):
            top, link = -1e300, 0
            start = end - 1
            low = end - c.longest if end > c.longest else 0
            while start >= low:
                v = score(text[start:end], 0)
                if v is not None:
                    if v == 0:  # no piece ends in these characters
                        break
                    v += best[start]
                    if v > top:
                        top, link = v, start
                start -= 1
            if top == -1e300 or text[end - 1] not in c.id_of:
                v = best[end - 1] - BYTE_COST * len(text[end - 1].encode())
                if v > top:
                    top, link = v, end - 1
            best.append(top)
            back.append(link)

    def _commit(self) -> None:
        """Commits up to the last boundary that the paths to all boundaries in the window share."""
        last = len(self.text)
        live = set(range(max(last - self.codec.longest + 1, 0), last + 1))
        while len(live) > 1:
            end = max(live)
            live.discard(end)
            live.add(self.back[end])
        end = live.pop()
        if end:
            self._settle(end)
            self.commits += 1
            self.text = self.text[end:]
            self.best = [x - self.best[end] for x in self.best[end:]]
            self.back = [max(x - end, 0) for x in self.back[end:]]

    def _settle(self, end: int) -> None:
        c, found = self.codec, []
        while end:
            start = self.back[end]
            piece = self.text[start:end]
            found.append(c.id_of[piece] if piece in c.id_of else piece)
            end = start
        for x in reversed(found):
            if isinstance(x, str):
                self.ids.extend(c.byte[b] for b in x.encode())
            else:
                self.ids.append(x)

    def close(self) -> list[int]:
        self._settle(len(self.text))
        return self.ids


class PieceCodec:
    def __init__(self, model_file: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if norm.name != "identity" or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not model.trainer_spec.byte_fallback:
            raise ValueError("a model with identity normalisation, a space before the text and byte fallback is needed")
        bpe = model.trainer_spec.model_type == 2
        normal = [(i, p) for i, p in enumerate(model.pieces) if p.type == 1]
        rank = {p.piece: r for r, (_, p) in enumerate(normal)}
        self.scored = {p.piece: -log(rank[p.piece] + 2) if bpe else p.score for _, p in normal}
        self.id_of = {p.piece: i for i, p in normal}
        if any(a != SPACE and b == SPACE for p in self.scored for a, b in zip(p, p[1:])):
            raise ValueError("a piece has a space mark after another character")
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        # None for characters that end a piece and are none. Scores are below 0, which stands for what ends no piece.
        self.score_of_ending = {p[i:]: self.scored.get(p[i:]) for p in self.scored for i in range(len(p))}
        self.pairs = {p[i : i + 2] for p in self.scored for i in range(len(p) - 1)}
        self.longest = max(map(len, self.scored))
        self.bytes_of = [b""] * len(model.pieces)
        for i, p in normal:
            self.bytes_of[i] = p.piece.replace(SPACE, " ").encode()
        for b, i in self.byte.items():
            self.bytes_of[i] = bytes([b])
        self.known: dict[str, bytes] = {}
        self.known_bytes = 0
        self.inexact = 0  # stretches whose ids do not decode to them; there are none, or an error is at hand
        self.mark_ids = array("i", (self.byte[b] for b in SPACE.encode())).tobytes()

    def word(self, s: str) -> bytes:
        """The ids (32 bits each) of a word, which starts and ends where all paths meet; so do its parts between known boundaries."""
        found = self.known.get(s)
        if found is None:
            pairs = self.pairs
            cuts = [i for i, pair in enumerate(map(add, s, s[1:]), 1) if pair not in pairs]
            if cuts:
                found = b"".join(self.word(s[i:j]) for i, j in zip([0, *cuts], [*cuts, len(s)]))
            else:
                stream = Stream(self, known_boundaries=False)  # there is none in it
                stream.feed(s)
                ids = stream.close()
                found = array("i", ids).tobytes()
                self.inexact += b"".join(map(self.bytes_of.__getitem__, ids)).decode().replace(" ", SPACE) != s
            if len(s) <= KEEP_LENGTH:
                if self.known_bytes > KEEP_BYTES:
                    self.known.clear()
                    self.known_bytes = 0
                self.known[s] = found
                self.known_bytes += 185 + 2 * len(s) + len(found)
        return found

    def words(self, text: str) -> list[str]:
        """A text's parts: each run of spaces with the word that follows it. The first has the space before the text."""
        parts, run = [], 0
        for i, w in enumerate(text.split(" ")):
            run += 1
            if w:
                parts.append(SPACE * run + w)
                run = 0
        if run:
            parts.append(SPACE * run)
        return parts

    def encode(self, text: str) -> list[int]:
        return self.packed(text).tolist()

    def packed(self, text: str) -> np.ndarray:
        """The ids of a text."""
        return np.frombuffer(b"".join(self._parts(text)), np.int32) if text else np.zeros(0, np.int32)

    def _parts(self, text: str) -> list[bytes]:
        if SPACE in text:
            out: list[bytes] = []
            for i, part in enumerate(text.split(SPACE)):
                if i:
                    out.append(self.mark_ids)
                    body = self.words(part) if part else []
                    if body:
                        body[0] = body[0][1:]  # no space before the text here
                        out.extend(map(self.word, filter(None, body)))
                else:
                    out.extend(map(self.word, self.words(part)))
            return out
        known = self.known
        return [known.get(w) or self.word(w) for w in self.words(text)]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids))[1:].decode() if len(ids) else ""


def codec(model_file: str) -> PieceCodec:
    return kept_here(f"pieces {model_file}", lambda: PieceCodec(model_file))


def encode_documents(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, ids (array<int>), n_ids, exact (the ids decode to the very text).

    A null text counts as empty and has no ids. Repeated rows are encoded each, a very long text needs the window and its
    ids only, other columns are ignored, and an empty table gives an empty result. One narrow pass; model_file is read
    on each executor. Ids of pieces decode one by one, so each word's are compared with the word when it is first met.
    """

    def encoded(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(model_file)
        for p in parts:
            for at in range(0, len(p), SOME):
                some = p.iloc[at : at + SOME]
                ids, exact = [], []
                for t in some["t"]:
                    before = c.inexact
                    ids.append(c.packed(t))
                    exact.append(c.inexact == before)
                yield pd.DataFrame({"doc_id": some["doc_id"].array, "ids": ids, "n_ids": [len(x) for x in ids], "exact": exact})

    rows = docs.select(id_text(id_col).alias("doc_id"), whole(text_col).alias("t"))
    found = rows.mapInPandas(encoded, "doc_id string, ids array<int>, n_ids int, exact boolean")
    kind = docs.select(F.col(id_col).alias("doc_id")).schema["doc_id"].dataType
    return found.withColumn("doc_id", F.col("doc_id").cast(kind))


def decode_documents(rows: DataFrame, model_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of rows of ids. Null ids give an empty text."""

    @F.pandas_udf("string")
    def decoded(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(model_file)
        for s in parts:
            yield s.map(lambda x: c.decode(x) if x is not None else "")

    return rows.select(F.col(id_col).alias("doc_id"), decoded(F.col(ids_col)).alias("text"))
