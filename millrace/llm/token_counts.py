"""Token counts by byte-pair merging with a heap and a linked list.

The symbols of a text are its characters. The pair of neighbours whose union has the best rank is popped from a heap, the leftmost first
among equals, and becomes one symbol of a doubly linked list; its new neighbours are pushed. Every merge takes one symbol away, so the
count is the number of initial symbols (a character that is no piece stands for its UTF-8 bytes) minus the merges, and no piece is looked
up as an id.

No piece crosses certain boundaries, which are read from the vocabulary: a text is cut there first and the count of each distinct part is
kept (at most MEMO parts a worker).

Defined results: null counts as empty, 0 bytes and 0 tokens. Repeated rows and null ids give a row each; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm._common import kept, read, ship, spread

LIMIT = 4096
MEMO = 250_000
SPACE = "▁"
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"


class Counter:
    """Counts of a sentencepiece BPE model with byte fallback and the identity normaliser."""

    def __init__(self, path: str):
        import regex
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, train = model.normalizer_spec, model.trainer_spec
        if train.model_type != train.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or not train.byte_fallback or train.treat_whitespace_as_suffix:
            raise ValueError(f"{path} isn't a BPE model with byte fallback and the identity normaliser")
        if any(p.type == p.USER_DEFINED for p in model.pieces):
            raise ValueError("user-defined pieces are not supported")
        self.prefix = SPACE if norm.add_dummy_prefix else ""
        self.rank = {p.piece: -p.score for p in model.pieces if p.type == p.NORMAL}
        letter = regex.compile(f"[{LETTERS}]").match
        pairs = {(p[i], p[i + 1]) for p in self.rank for i in range(len(p) - 1)}
        if any(b == SPACE and a != SPACE for a, b in pairs):
            self.cut = lambda s: [s]
        else:
            out = any(letter(a) and not letter(b) for a, b in pairs)
            into = any(not letter(a) and a != SPACE and letter(b) for a, b in pairs)
            word, rest = f"[{LETTERS}]+", f"[^{SPACE}{LETTERS}]+"
            part = f"[^{SPACE}]+" if out and into else f"{word}(?:{rest})?|{rest}" if out else f"(?:{rest})?{word}|{rest}" if into else f"{word}|{rest}"
            self.cut = regex.compile(f"{SPACE}*(?:{part})|{SPACE}+").findall
        self.memo: dict[str, int] = {}

    def part(self, s: str) -> int:
        """The tokens of one part."""
        rank = self.rank
        symbols: list[str | None] = list(s)
        n = len(symbols)
        count = sum(1 if c in rank else len(c.encode()) for c in s)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if (r := rank.get(pair := s[i : i + 2])) is not None:
                heap.append((r, i, pair))
        heapify(heap)
        while heap:
            _, i, pair = heappop(heap)
            left, j = symbols[i], after[i]
            if left is None or j >= n or len(left) + len(symbols[j]) != len(pair):  # one of them has been merged since
                continue
            symbols[i], symbols[j] = pair, None
            count -= 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get(new := pair + symbols[k])) is not None:
                    heappush(heap, (r, i, new))
            if (h := before[i]) >= 0 and (r := rank.get(new := symbols[h] + pair)) is not None:
                heappush(heap, (r, h, new))
        return count

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        memo, total = self.memo, 0
        for s in self.cut(self.prefix + text.replace(" ", SPACE)):
            n = memo.get(s)
            if n is None:
                if len(memo) >= MEMO:
                    memo.clear()
                n = self.part(s)
                if len(s) <= 64:
                    memo[s] = n
            total += n
        return total


def counter(path: str) -> Counter:
    """One for each worker process."""
    return kept(f"counter {path}", lambda: Counter(path))


def token_counts(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per row of docs: its id, n_bytes, n_tokens, over_limit."""

    def of(batches):
        import pyarrow as pa

        c = counter(path)
        for b in batches:
            n = pa.array([c.count(t) for t in b.column("t").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column("n_bytes"), n], [doc_id, "n_bytes", "n_tokens"])

    ship(docs.sparkSession)
    rows = docs.select(F.col(doc_id), F.octet_length(F.coalesce(text, F.lit(""))).cast("long").alias("n_bytes"), F.col(text).alias("t"))
    out = spread(rows).mapInArrow(of, T.StructType([rows.schema[doc_id], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    """The contract's counts over documents."""
    import public_tokenizers

    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
