"""Token ids of a byte-level BPE vocabulary, by the tokenizers library.

Byte-level BPE merges within the pieces that its pattern cuts a text into, so the library is asked once for each distinct piece and the
answer is kept (at most about MEMO pieces a worker, some 50 MB: executors may run more workers than tasks; beyond that the rare ones go). Pieces are numbered as they
come; the ids of a chunk of texts are then gathered from one array. Texts with anything on which two implementations of the pattern could differ (characters
beyond Latin, controls, a special token's brackets) go through the library whole.
"""

from __future__ import annotations

MEMO = 220_000
#: Highest character of the texts that are cut here: the Latin blocks, without controls other than tab and line ends, no-break space and soft hyphen.
PLAIN = "".join(c for c in map(chr, range(0x250)) if c in "\t\n\r" or c.isprintable())


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def plain_pattern() -> str:
    """The pattern of public_tokenizers with its classes written out for PLAIN."""
    import re
    from unicodedata import category

    from public_tokenizers import PATTERN

    of = lambda kind: "".join(map(re.escape, (c for c in PLAIN if category(c)[0] == kind)))
    letters, numbers = of("L"), of("N")
    return PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{letters}{numbers}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]")


class Numbers(dict):
    """Numbers of pieces; a new piece gets the next one and waits in pending."""

    def __init__(self):
        super().__init__()
        self.pending: list[str] = []

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self)
        self.pending.append(piece)
        return n


class Encoder:
    """Ids of texts as bytes of little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        import os
        import re

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import numpy as np
        from tokenizers import Tokenizer, pre_tokenizers

        self.path, self.tokenizer = path, None
        self.by_piece = Tokenizer.from_file(path)
        self.by_piece.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)  # pieces are cut already
        vocab = self.by_piece.get_vocab()
        self.bytes_of = np.zeros(max(vocab.values()) + 1, np.int64)  # a byte-level token has a character for each byte
        for token, i in vocab.items():
            self.bytes_of[i] = len(token)
        self.cut = re.compile(plain_pattern()).findall
        self.plain = re.compile(f"[{re.escape(PLAIN)}]*").fullmatch
        self.special = tuple(t.content for t in self.by_piece.get_added_tokens_decoder().values())
        self._forget()

    def _whole(self, text: str) -> bytes:
        import numpy as np
        from tokenizers import Tokenizer

        if self.tokenizer is None:
            self.tokenizer = Tokenizer.from_file(self.path)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _forget(self) -> None:
        import numpy as np

        self.memo = Numbers()
        self.known, self.filled = 0, 0  # pieces and ids that the arrays hold
        self.start, self.count, self.ids = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32)
        self.used = np.zeros(1024, np.int64)

    def _thin(self) -> None:
        """Forget pieces, but keep up to half of MEMO of them: those seen most often among those seen more than once."""
        import numpy as np

        used, count, start, ids = self.used[: self.known], self.count[: self.known], self.start[: self.known], self.ids
        keep = np.flatnonzero(used > 1)
        if len(keep) > MEMO // 2:
            keep = np.sort(keep[np.argsort(-used[keep], kind="stable")[: MEMO // 2]])
        names = list(self.memo)
        self._forget()
        self.memo.update(zip([names[i] for i in keep.tolist()], range(len(keep))))
        count, ends = count[keep], np.cumsum(count[keep])
        total = int(ends[-1]) if len(ends) else 0
        self.ids = np.resize(ids[np.repeat(start[keep] - (ends - count), count) + np.arange(total)], max(total, 4096))
        size = max(len(keep), 1024)
        self.start, self.count, self.used = (np.resize(x, size) if len(keep) else np.zeros(size, np.int64) for x in (ends - count, count, used[keep] // 2))
        self.known, self.filled = len(keep), total

    def _learn(self) -> None:
        """Ask the library for the ids of the pending pieces, many a call."""
        import numpy as np

        pieces, self.memo.pending = self.memo.pending, []
        for i in range(0, len(pieces), 2000):
            some = pieces[i : i + 2000]
            ids = np.array(self.by_piece.encode_batch_fast([some], is_pretokenized=True, add_special_tokens=False)[0].ids, np.uint32)
            ends, wanted = np.cumsum(self.bytes_of[ids]), np.cumsum([len(x.encode()) for x in some])
            last = np.searchsorted(ends, wanted) + 1
            if not np.array_equal(ends[last - 1], wanted):
                raise ValueError("tokens don't end where pieces do")
            while self.known + len(some) > len(self.start):
                self.start, self.count, self.used = (np.resize(x, 2 * len(x)) for x in (self.start, self.count, self.used))
            while self.filled + len(ids) > len(self.ids):
                self.ids = np.resize(self.ids, 2 * len(self.ids))
            first = np.concatenate([[0], last[:-1]])
            self.start[self.known : self.known + len(some)] = self.filled + first
            self.count[self.known : self.known + len(some)] = last - first
            self.used[self.known : self.known + len(some)] = 0
            self.ids[self.filled : self.filled + len(ids)] = ids
            self.known, self.filled = self.known + len(some), self.filled + len(ids)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; null is empty."""
        from itertools import chain

        import numpy as np

        if len(self.memo) > MEMO:
            self._thin()
        texts = [t or "" for t in texts]
        cut = [self.cut(t) if self.plain(t) and not any(s in t for s in self.special) else None for t in texts]
        sizes = [len(p) if p is not None else 0 for p in cut]
        number = np.fromiter(map(self.memo.__getitem__, chain.from_iterable(p for p in cut if p is not None)), np.int64, sum(sizes))
        if self.memo.pending:
            self._learn()
        self.used[: self.known] += np.bincount(number, minlength=self.known)
        counts = self.count[number]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        raw = self.ids[np.repeat(self.start[number] - (ends - counts), counts) + np.arange(total)].astype("<u4").tobytes()
        upto = np.concatenate([[0], ends])[np.cumsum([0, *sizes])].tolist()
        return [raw[4 * a : 4 * b] if p is not None else self._whole(t) for t, p, a, b in zip(texts, cut, upto, upto[1:])]


def in_chunks(lengths: list[int], most: int = 500_000):
    """Ranges of consecutive texts of together about most characters."""
    at, total = 0, 0
    for i, n in enumerate(lengths):
        total += n
        if total >= most:
            yield range(at, i + 1)
            at, total = i + 1, 0
    if at < len(lengths):
        yield range(at, len(lengths))


def encoder(path: str) -> Encoder:
    """One for each worker process."""
    from millrace.llm._common import kept

    return kept(f"encoder {path}", lambda: Encoder(path))
