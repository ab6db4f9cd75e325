"""Token counts by overlap resynchronisation.

A text of up to ``chunk`` characters is encoded as it is. A longer one is encoded in
chunks that overlap; from the ids follows the character offset of every token. Two
neighbouring chunks are spliced at a token boundary that both have inside their
overlap and that is proven stable: between two characters that no vocabulary
entry holds side by side. No merge ever crosses such a place, so what stands left and right of it is encoded
independently. A space after another character is one (checked when the vocabulary is loaded), and so are most places in
texts without spaces. If an overlap has no such boundary, it is widened, up to the whole
rest of the text. If a vocabulary lacks the property for spaces, whole texts are encoded.

Defined cases: a null or empty text has 0 bytes and 0 tokens; repeated rows get equal
counts; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lumidisc.llm import kernels as k
from lumidisc.llm.common import ids_and_texts, in_batches

SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"
CHUNK, OVERLAP = 16_384, 512
_SPACE = "▁"


class PieceEncoder:
    """A sentencepiece vocabulary with the number of characters that each id stands for."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.vocab_size()
        pieces = [self.model.id_to_piece(i) for i in range(n)]
        self.stable = not any(regex.search(f"[^{_SPACE}]{_SPACE}", p) for p in pieces)
        # characters side by side, if the vocabulary takes texts as they are
        plain = "ﬁ１２Å½①é日本　"
        self.together = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)} if self.model.normalize(plain) == _SPACE + plain else None
        self.chars = np.array([len(p) for p in pieces])
        for i in range(n):
            if self.model.is_byte(i):  # a character counts at its first byte
                self.chars[i] = int(pieces[i][1:-1], 16) & 0xC0 != 0x80
            elif self.model.is_unknown(i):
                self.stable = self.stable and self.model.piece_to_id("<0x00>") != i

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)

    def boundaries(self, text: str) -> np.ndarray:
        """Where each token of the text begins; the first begins at -1, with the space that the library puts in front."""
        return np.concatenate(([0], np.cumsum(self.chars[np.array(self.ids([text])[0], np.int64)])))[:-1] - 1

    def count(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        if len(text) <= chunk or not self.stable:
            return len(self.ids([text])[0])
        total, begin, end = 0, 0, chunk  # tokens before `keep` are counted
        at, keep = self.boundaries(text[:end]), -1
        while end < len(text):
            width = overlap
            while True:
                start = max(begin + 1, end - width)
                stop = min(len(text), start + chunk + width)
                after = self.boundaries(text[start:stop]) + start
                splice = self._splice(text, at, after, max(start, keep) + 1, end)
                if splice is not None or start == begin + 1:
                    break
                width *= 2
            if splice is None:  # nothing to splice at: encode on from the same place
                end = min(len(text), begin + 2 * (end - begin))
                at = self.boundaries(text[begin:end]) + begin
                continue
            total += int(np.searchsorted(at, splice) - np.searchsorted(at, keep))
            begin, end, at, keep = start, stop, after, splice
        return total + len(at) - int(np.searchsorted(at, keep))

    def _splice(self, text: str, left: np.ndarray, right: np.ndarray, low: int, high: int) -> int | None:
        """The last stable boundary of both chunks between the places."""
        both = np.intersect1d(left[(left > low) & (left < high)], right[(right > low) & (right < high)])
        return next((int(p) for p in both[::-1] if self.apart(text[p - 1], text[p])), None)

    def apart(self, a: str, b: str) -> bool:
        """Whether no token can hold both characters, the first before the second."""
        if b == " ":
            return a != " "
        return self.together is not None and a.replace(" ", _SPACE) + b not in self.together


_LOADED: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    if path not in _LOADED:
        _LOADED[path] = PieceEncoder(path)
    return _LOADED[path]


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every document. ``path``: the vocabulary file, on every worker."""

    def work(batch: pa.RecordBatch) -> dict:
        e, column = encoder(path), batch.column("text")
        n = np.zeros(batch.num_rows, np.int64)
        t = k.texts(column)
        for i, j, part in k.blocks(t, 1 << 20):
            raw = part.buf.tobytes()
            own = [raw[a:b].decode("utf-8", "replace") for a, b in zip(part.off[:-1], part.off[1:], strict=True)]
            short = [x for x in range(j - i) if len(own[x]) <= chunk]
            for x, ids in zip(short, e.ids([own[x] for x in short]), strict=True):
                n[i + x] = len(ids)
            for x in set(range(j - i)).difference(short):
                n[i + x] = e.count(own[x], chunk, overlap)
        return {"doc_id": batch.column("doc_id"), "n_bytes": np.diff(t.off), "n_tokens": n, "over_limit": n > limit}

    return in_batches(ids_and_texts(docs), work, SCHEMA)
