"""Token ids of whole texts, with a bounded memory of words already split.

A text's ids are those of its white-space separated runs one after another,
because the tokenizer's own splitting never crosses white space. Each run is
looked up first; only runs not met before reach the tokenizer. Anything out of
the ordinary (controls, scripts beyond Latin, very long runs, special-token
strings) goes through the tokenizer as a whole.
"""

from __future__ import annotations

import unicodedata

import numpy as np

REMEMBERED = 1 << 20   # runs kept per Python worker; then forgotten and begun anew
LONG_RUN = 64
_ODD_SPACES = "\x1c\x1d\x1e\x1f"  # white space to str.split, not to the tokenizer
# fixed value: the pre-token pattern of the word_bpe_49k vocabulary
_PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class _Runs(dict):
    """Run of a text -> bytes of its ids."""

    def __init__(self, tokenizer):
        import regex
        from tokenizers.pre_tokenizers import ByteLevel
        super().__init__()
        self.tokenizer, self.model = tokenizer, tokenizer.model
        self.kind = np.uint16 if tokenizer.get_vocab_size(True) <= 1 << 16 else np.uint32
        self.split = regex.compile(_PRE_TOKEN).findall
        self.to_bytes = ByteLevel(add_prefix_space=False, use_regex=False)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.kind).tobytes()

    def _word(self, word: str) -> bytes:
        if not word.isascii():
            word = self.to_bytes.pre_tokenize_str(word)[0][0]
        return np.array([t.id for t in self.model.tokenize(word)], dtype=self.kind).tobytes()

    def __missing__(self, run: str) -> bytes:
        if len(run) > LONG_RUN:
            return self.whole(run)
        if "<|" in run or not run.isprintable() or max(run) >= "ɐ":
            found = self.whole(run)
        else:
            low = unicodedata.normalize("NFC", run).lower()
            if low != run and low.isascii():
                found = self[low]
            elif low.isalpha():
                found = self._word(low)
            else:
                parts = self.split(low)
                found = b"".join([self[p] if p != run else self._word(p) for p in parts])
        if len(self) >= REMEMBERED:
            self.clear()
        self[run] = found
        return found


_LOADED: dict[str, _Runs] = {}


class Encoder:
    """Ids by the tokenizer file at ``path`` (``add_special_tokens=False``)."""

    def __init__(self, path: str):
        if path not in _LOADED:
            import json
            from tokenizers import Tokenizer
            with open(path, encoding="utf-8") as f:
                steps = json.load(f)["pre_tokenizer"]["pretokenizers"]
            if steps[0].get("pattern", {}).get("Regex") != _PRE_TOKEN:
                raise ValueError(f"{path}: another splitting pattern than that of word_bpe_49k")
            _LOADED[path] = _Runs(Tokenizer.from_file(path))
        self.runs = _LOADED[path]

    def ids(self, text: str) -> np.ndarray:
        if any(c in text for c in _ODD_SPACES):
            raw = self.runs.whole(text)
        else:
            raw = b"".join(map(self.runs.__getitem__, text.split()))
        return np.frombuffer(raw, dtype=self.runs.kind)
