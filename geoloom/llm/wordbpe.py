"""Word-wise use of a ``tokenizers`` file whose pre-tokenizer drops white space.

For such a tokenizer the ids of a text are the ids of its space-separated chunks, one after the other, so a
chunk met before needs no second call.  The memo is bounded: two generations of ``limit`` chunks each.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np

from .held import keep


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer file and of the library that reads it."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()[:16]


#: The pre-tokenizer pattern for which chunks can be cut further here, and the same for lower-case Latin-1 text.
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
LATIN = re.compile("[\t\n -~À-ÿ]+")
WORD = re.compile("[a-zß-öø-ÿ]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\\s0-9a-zß-öø-ÿ]+")


def _stands_alone(spec: dict) -> bool:
    """Whether space-separated chunks have ids of their own: white space is dropped and no special token can reach across a space."""
    kinds = [p.get("type") for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
    return kinds[:1] == ["Split"] and spec.get("post_processor") is None and not any(
        " " in m["content"] or m["lstrip"] or m["rstrip"] or m["single_word"] for m in spec.get("added_tokens") or []
    )


def drops_white_space(path: str) -> bool:
    """Whether runs of white space make no difference to the ids that the tokenizer file gives."""
    with open(path, encoding="utf-8") as f:
        return _stands_alone(json.load(f))


class WordEncoder:
    """``encode(text)`` gives the ids as little-endian unsigned 32-bit bytes, without added special tokens.

    A text of plain Latin letters, digits and signs is cut into its pre-tokens here; new ones reach the library many
    at a time, told apart by the word-end mark of their last piece.  Any other text is cut at spaces only.
    """

    LONG = 48  # longer chunks are encoded but not remembered

    def __init__(self, path: str, limit: int = 220_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.chunked = _stands_alone(spec)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.limit, self.new, self.old = limit, {}, {}
        pattern = next((p["pattern"].get("Regex") for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if p.get("type") == "Split"), None)
        steps = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        end = spec["model"].get("end_of_word_suffix")
        self.latin = self.chunked and pattern == SPLIT and steps == ["NFC", "Replace", "Lowercase"] and bool(end)
        if self.latin:
            ids = spec["model"]["vocab"]
            self.ends = np.zeros(max(ids.values()) + 1, bool)
            self.ends[[i for t, i in ids.items() if t.endswith(end)]] = True

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in found]

    def encode(self, text: str | None) -> bytes:
        return next(self.encode_all([text]))

    def encode_all(self, texts: list[str | None]):
        """Ids of each text in turn; new chunks of some hundred thousand characters are looked up together."""
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size < 400_000):
                size += len(texts[end] or "")
                end += 1
            part = texts[at:end]
            at = end
            if not self.chunked:
                yield from (ids if t else b"" for t, ids in zip(part, self._ids([t or "" for t in part]), strict=True))
                continue
            lists = [self._cut(t or "") for t in part]
            new, old, extra = self.new, self.old, {}
            miss = set().union(*lists).difference(new)
            known = miss & old.keys() if old else ()
            for c in known:
                new[c] = old[c]
            for c, ids in self._look_up(miss.difference(known)):
                (new if len(c) <= self.LONG else extra)[c] = ids
            if extra:
                yield from (b"".join([new[c] if c in new else extra[c] for c in x]) for x in lists)
            else:
                yield from (b"".join([new[c] for c in x]) for x in lists)
            if len(new) > self.limit:
                self.old, self.new = new, {}

    def _cut(self, text: str) -> list[str]:
        if self.latin and LATIN.fullmatch(text) and "<|" not in text:
            return WORD.findall(text.lower())
        return text.replace("\n", " ").split(" ")

    def _look_up(self, miss: set[str]) -> list[tuple[str, bytes]]:
        words = [c for c in miss if self.latin and WORD.fullmatch(c) and LATIN.fullmatch(c) and "<|" not in c]
        other = list(miss.difference(words))
        out = list(zip(other, self._ids(other), strict=True)) if other else []
        if words:
            ids = np.frombuffer(self._ids([" ".join(words)])[0], "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(words):
                raw, at = ids.tobytes(), 0
                for w, stop in zip(words, (4 * stops).tolist(), strict=True):
                    out.append((w, raw[at:stop]))
                    at = stop
            else:  # a pre-token that ends in no mark: one by one
                out += zip(words, self._ids(words), strict=True)
        return out


def encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker, kept from task to task."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return keep(("words", path), lambda: WordEncoder(path))
