"""Token counts by byte-pair merging with a heap and a linked list.

The model's merges are ranked by its piece scores. In each stretch of text the adjacent pair of lowest rank (leftmost
in a tie) is popped from a heap and joined in a linked list until no pair is a piece; the count is the initial
symbols less the merges, plus the further bytes of characters that the model spells as bytes. No ids are made.

No piece has a space mark after another character, so no merge crosses the start of a word: a text's count is the sum
over its stretches. Nor does one cross two characters that stand side by side in no piece, so stretches fall into
parts ("word" and "!!"). The counts of short stretches and parts are kept in a bounded table in each worker.

One narrow pass without a shuffle: text and count meet in the same row, nothing is gathered.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import kept_here, whole

SPACE = "▁"
#: Stretches longer than this are counted anew each time; the table of counts is emptied when it is full.
KEEP_LENGTH, KEEP_COUNT = 40, 1_500_000


class PieceCounter:
    """Counts tokens as the sentencepiece library does for a BPE model with byte fallback and identity normalisation."""

    def __init__(self, model_file: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        norm, train = model.normalizer_spec, model.trainer_spec
        if train.model_type != 2 or norm.name != "identity" or norm.remove_extra_whitespaces or not train.byte_fallback:
            raise ValueError("a BPE model with identity normalisation and byte fallback is needed")
        self.prefix = norm.add_dummy_prefix
        self.rank = {p.piece: int(-p.score) for p in model.pieces if p.type == 1}
        self.inner = {c for p in self.rank if len(p) > 1 for c in p}
        self.pairs = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}
        self.single = {p for p in self.rank if len(p) == 1}
        if any(a != SPACE and b == SPACE for p in self.rank for a, b in zip(p, p[1:])):
            raise ValueError("a piece has a space mark after another character")
        self.known: dict[str, int] = {}

    def merged(self, s: str) -> int:
        """Tokens of one stretch."""
        count = n = len(s)
        if not self.single.issuperset(s):
            count += sum(len(c.encode()) - 1 for c in s if c not in self.single)
        rank = self.rank.get
        # A heap entry is one number, rank * n + position; it is stale if the pair there has another rank by now.
        heap = [r * n + i for i in range(n - 1) if (r := rank(s[i : i + 2])) is not None]
        if not heap:
            return count
        heapify(heap)
        text = [*s, ""]
        before, after = list(range(-1, n)), list(range(1, n + 2))
        while heap:
            r, i = divmod(heappop(heap), n)
            a, j = text[i], after[i]
            if not a or j >= n or rank(pair := a + text[j]) != r:
                continue
            text[i], text[j] = pair, ""
            count -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank(pair + text[k])) is not None:
                    heappush(heap, r * n + i)
            h = before[i]
            if h >= 0 and (r := rank(text[h] + pair)) is not None:
                heappush(heap, r * n + h)
        return count

    def stretch(self, s: str) -> int:
        """Tokens of a stretch that starts a word: the sum over the parts between which no merge can reach."""
        pairs, known, count, start = self.pairs, self.known, 0, 0
        for i in range(1, len(s) + 1):
            if i == len(s) or s[i - 1 : i + 1] not in pairs:
                part = s[start:i]
                n = known.get(part)
                if n is None:
                    n = self.merged(part)
                    if start or i < len(s):
                        self.keep(part, n)
                count += n
                start = i
        return count

    def keep(self, s: str, n: int) -> None:
        if len(s) <= KEEP_LENGTH:
            if len(self.known) >= KEEP_COUNT:
                self.known.clear()
            self.known[s] = n

    def count(self, text: str) -> int:
        if not text:
            return 0
        s = text.replace(" ", SPACE)
        if self.prefix:
            s = SPACE + s
        known, total = self.known, 0
        for line in s.split("\n") if "\n" not in self.inner else [s]:
            words = line.split(SPACE)
            if "" in words[1:]:  # a run of spaces is a stretch with the word that follows
                words, run = words[:1], 0
                parts = line.split(SPACE)[1:]
                for k, w in enumerate(parts):
                    run += 1
                    if w or k == len(parts) - 1:
                        words.append(SPACE * (run - 1) + w)
                        run = 0
            for k, w in enumerate(words):
                key = SPACE + w if k else w
                n = known.get(key)
                if n is None:
                    n = self.stretch(key)
                    self.keep(key, n)
                total += n
        return total + (s.count("\n") if "\n" not in self.inner else 0)


def counter(model_file: str) -> PieceCounter:
    return kept_here(f"tokens {model_file}", lambda: PieceCounter(model_file))


def token_counts(docs: DataFrame, model_file: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    model_file is read on each executor, from the same path everywhere. A null text counts as empty: 0 bytes, 0
    tokens. Whole texts, however long; repeated rows are counted each; other columns are ignored, and an empty table
    gives an empty result.
    """

    @F.pandas_udf("bigint")
    def tokens(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = counter(model_file)
        for s in parts:
            yield s.map(c.count).astype("int64")

    rows = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("_t"))
    out = rows.select("doc_id", F.octet_length("_t").cast("bigint").alias("n_bytes"), tokens("_t").alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
