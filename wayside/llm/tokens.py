"""Token ids of whole texts, through a bounded cache of words.

A tokenizer that drops white space, lowers case and never lets a token cross white space
gives a text the ids of its words, one after another.  Each worker therefore keeps the ids of
words it has met (at most ``limit`` of them, then it starts anew) and runs the tokenizer only
for new ones.  ``Encoder`` reads from the tokenizer file whether that holds; if it does not,
whole texts go to the tokenizer.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata

import numpy as np

END_ID = 2
TOKENIZER = "word_bpe_49k.json"
#: Words that a worker keeps before it starts anew, the former ones being kept till then: 200 MB in all at most.
WORDS = 400_000
_TAIL = b"!\"#$%&()*+,-./:;=?@[\\]^_`{|}~"
_RUN = 200


def tokenizer_path(path: str | None = None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    return path


def by_words(spec: dict) -> bool:
    """Whether a text's ids are the ids of its words: what Encoder's cache rests on."""
    norm, pre, model = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}, spec["model"]
    split = (pre.get("pretokenizers") or [{}])[0]
    return (
        [x["type"] for x in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        and norm["normalizers"][1] == {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
        and split.get("type") == "Split"
        and split.get("pattern") == {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
        and (split.get("behavior"), split.get("invert")) == ("Removed", True)
        and (model["type"], model.get("dropout"), spec.get("post_processor"), spec.get("truncation")) == ("BPE", None, None, None)
        and not any(re.search(r"\s", x["content"]) or x["lstrip"] or x["rstrip"] or "<|" not in x["content"] for x in spec["added_tokens"])
    )


def _byte_letters() -> dict[int, int]:
    """Byte-level alphabets write bytes that print as themselves and the rest from U+0100 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in prints]
    return {b: 0x100 + k for k, b in enumerate(rest) if b != 0x20}  # blanks part words


class Encoder:
    """A tokenizer file's ids for whole texts; at most 2 * ``limit`` words are held."""

    def __init__(self, path: str, limit: int = WORDS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer, self.limit, self.cached = Tokenizer.from_file(path), limit, by_words(spec)
        self.ids: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.vocabulary = self.tokenizer.get_vocab_size()
        if self.cached:
            # The same merges for words that are lower-case letters in NFC already: no normalizer, split at blanks.
            self.plain = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}))
            self.letters = _byte_letters()
            self.ends = np.zeros(self.vocabulary, bool)
            for token, i in self.tokenizer.get_vocab().items():
                self.ends[i] = token.endswith(spec["model"].get("end_of_word_suffix") or "\0")

    def _learn(self, words: list[bytes]) -> None:
        ids, new, pairs = self.ids, [], []
        cores = set()
        for w in words:
            if w[-1] in _TAIL:
                core = w.rstrip(_TAIL)
                if core and 97 <= core[-1] <= 122:  # a token never joins a letter and these marks
                    pairs.append((w, core, w[len(core) :]))
                    cores.add(core)
                    cores.add(w[len(core) :])
                    continue
            new.append(w)
        if cores:
            new = [w for w in cores.union(new) if w not in ids]
        letters, rest = [], []
        for k in range(0, len(new), _RUN):
            run = new[k : k + _RUN]
            spelled = b" ".join(run).decode()
            composed = unicodedata.is_normalized("NFC", spelled)
            for w, s in zip(run, spelled.split(" "), strict=True):
                (letters if s.isalpha() and s == s.lower() and (composed or s.isascii()) else rest).append(w)
        runs = [letters[k : k + _RUN] for k in range(0, len(letters), _RUN)]
        for run, e in zip(runs, self.plain.encode_batch_fast([b" ".join(r).decode("latin-1").translate(self.letters) for r in runs], add_special_tokens=False), strict=True):
            flat = np.array(e.ids, np.uint32)
            cut = (4 * (np.flatnonzero(self.ends[flat]) + 1)).tolist()
            if len(cut) != len(run):
                rest += run
                continue
            packed, begin = flat.tobytes(), 0
            for w, end in zip(run, cut, strict=True):
                ids[w] = packed[begin:end]
                begin = end
        for w, e in zip(rest, self.tokenizer.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False), strict=True):
            ids[w] = np.array(e.ids, np.uint32).tobytes()
        for w, core, tail in pairs:
            ids[w] = ids[core] + ids[tail]

    def _renew(self, words: set[bytes]) -> None:
        """Every word of ``words`` is in ``ids`` afterwards."""
        if len(self.ids) + 2 * len(words) > self.limit:
            self.older, self.ids = self.ids, {}
        new = [w for w in words if w not in self.ids]
        if new and self.older:
            held = {w: self.older[w] for w in new if w in self.older}
            self.ids |= held
            new = [w for w in new if w not in held]
        if new:
            self._learn(new)

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """The ids of each text (null: none) as packed little-endian unsigned 32-bit integers."""
        texts = [t or b"" for t in texts]
        if not self.cached:
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
        split = [t.split() if b"<|" in t else t.lower().split() for t in texts]
        self._renew(set().union(*split))
        get = self.ids.__getitem__
        return [b"".join(map(get, words)) for words in split]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str, limit: int = WORDS) -> Encoder:
    """This process's encoder for a tokenizer file; from now on it keeps ``limit`` words."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    _ENCODERS[path].limit = limit
    return _ENCODERS[path]


def forget(path: str) -> None:
    """Gives back a tokenizer and the words it has met, for stages that need the memory."""
    _ENCODERS.pop(path, None)
