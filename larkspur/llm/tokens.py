"""Token ids of a public byte-level BPE vocabulary, as little-endian unsigned 32-bit bytes.

tokenizers gives the ids; its twin file of ranks gives the same ids faster through tiktoken, so that
runs the bulk. Every worker compares the two on PROBES when it opens the vocabulary; if they differ, or without the twin, tokenizers does it
all, as it does for texts that hold one of the vocabulary's added tokens. A text
is cut before spaces where the vocabulary's pattern always cuts, and the pieces found so far are kept,
at most KEPT of them (beyond that, pieces are found anew).
"""

from __future__ import annotations

import base64
import os
import re
from itertools import islice

import numpy as np

KEPT = 300_000
#: One of each thing that the pattern or the merges could treat differently.
PROBES = (
    "Hello, world! It's 12 o'clock; we'll say they've done what I'd do, don't you're I'm", " lead and trail ", "  two  spaces   three\n\n lines \t x ", "a \n b\r\nc\x0b\x0c d",
    "é ñ ß İ ŒUVRE naïve", "漢字かな交じり文 한국어 Здравствуй مرحبا עולם", "🎉🎉 👩\u200d👩\u200d👧 e\u0301", "½ ² ٣ Ⅷ 1 22 333 4444 12345678", "x_y-z@example.org/a?b=c&d#e %20 $5.00 <b>q</b> {[(|)]}",
    "nb\xa0sp\u2003em\u200bzero\ufeff", "A" * 70 + "ab" * 40 + "." * 30 + "=" * 33, "'S 'T 'RE 's's 't't '' \"quoted\"", "\x00\x01\x7f tab\tend", "",
)
_RUN = re.compile(r"\s \s")  # a cut inside a run of white space could move its pieces


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        twin = path.removesuffix(".json") + ".tiktoken"
        self.fast = None
        if os.path.exists(twin):
            import tiktoken

            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            with open(twin, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("twin", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            self.opens = np.zeros(max(ranks.values()) + 1, bool)
            self.opens[[i for b, i in ranks.items() if b[:1] == b" "]] = True
            self.known: dict[str, bytes] = {}  # of " " + key
            if any(self._whole(p) != self._ids(p) for p in PROBES):
                self.fast = None
        self.added = [t.content for t in self.slow.get_added_tokens_decoder().values()]

    def _whole(self, text: str) -> bytes:
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _ids(self, text: str) -> bytes:
        return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """Ids of " " + each; those without white space in one go, told apart by the ids that open with a space."""
        plain = [w for w in new if w and not any(map(str.isspace, w))]
        out = {w: self._ids(" " + w) for w in new if not w or any(map(str.isspace, w))}
        if plain:
            ids = np.array(self.fast.encode_ordinary(" " + " ".join(plain)), "<u4")
            at = np.flatnonzero(self.opens[ids])
            if len(at) == len(plain):
                raw, cuts = ids.tobytes(), (np.append(at, len(ids)) * 4).tolist()
                out.update((w, raw[a:b]) for w, a, b in zip(plain, cuts, cuts[1:], strict=False))
            else:
                out.update((w, self._ids(" " + w)) for w in plain)
        return out

    def encode(self, text: str) -> bytes:
        if self.fast is None or any(t in text for t in self.added):
            return self._whole(text)
        if _RUN.search(text):
            return self._ids(text)
        first, *rest = text.split(" ")
        known = self.known
        new = [w for w in dict.fromkeys(rest) if w not in known]
        if new:
            learnt = self._learn(new)
            if len(known) < KEPT:
                known.update(islice(learnt.items(), KEPT - len(known)))
            here = known if len(known) < KEPT else None
            if here is None:
                return self._ids(first) + b"".join([known[w] if w in known else learnt[w] for w in rest])
        return (self._ids(first) if first else b"") + b"".join([known[w] for w in rest])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for the file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
