"""Exact token ids of whole texts by a tokenizer file, with the encoding of repeated words kept.

Each text is cut at places where the tokenizer's own splitting rule always cuts, so the pieces can be encoded
separately by the tokenizers library and joined; a piece met before is looked up. The cuts:

* byte_bpe (its rule keeps one space with the word that follows): before a single space or line end that stands between
  two visible characters. A run of white space stays with its neighbours.
* word_bpe (white space is dropped, so nothing spans it): at every run of white space.

Files with other normalisers or splitters than these two are refused.

With `added`, as in the library's own encode, the tokenizer's added tokens (<|endoftext|>) become their ids: texts are
split at them first and what stands between is encoded as above. Without it they are text like any other.

Tests hold the ids against whole-text encoding. The kept pieces are bounded in number and length.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct pieces kept by a worker; beyond it the rarer ones go; after a piece longer than LONGEST_KEPT all do.
MOST_KEPT = 900_000
LONGEST_KEPT = 4096

_loaded: dict[tuple[str, str, bool], "Encoder"] = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable Latin-1, else the next from U+0100."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Encoder:
    """Ids of texts. cut: "space" or "word", the rule above. added: the tokenizer's added tokens in a text get their ids."""

    #: The splitting rule of byte-level vocabularies (fixed value, published with them).
    BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str, cut: str, added: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        known = self.tokenizer.get_added_tokens_decoder() if added else {}
        self.added = {t.content: i for i, t in known.items()}
        self.at_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split
        # added tokens that take white space along or are sought in normalised text are left to the library
        self.by_library = any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in known.values())
        self.normalise = self.tokenizer.normalizer.normalize_str if self.tokenizer.normalizer else None
        self.split, self.model = self.tokenizer.pre_tokenizer.pre_tokenize_str, self.tokenizer.model.tokenize
        self.wide = self.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16
        self.tokenizer.model._resize_cache(0)  # what repeats is kept here
        rules = json.loads(self.tokenizer.to_str())
        steps = rules["pre_tokenizer"].get("pretokenizers", [])
        for step in (rules["normalizer"] or {}).get("normalizers", []):
            if step["type"] not in ("NFC", "Lowercase") and step.get("pattern") != {"Regex": "\\s+"}:
                raise ValueError(f"{path}: normalizer {step} is not known here")
        if (rules["pre_tokenizer"]["type"] == "ByteLevel") != (cut == "space"):
            raise ValueError(f"{path} splits otherwise than cut={cut!r} does")
        rule = next((x["pattern"]["Regex"] for x in steps if x["type"] == "Split"), self.BYTE_LEVEL)
        ascii_rule = rule.replace("[\\p{L}]", "[A-Za-z]").replace("[\\p{N}]", "[0-9]").replace("?\\p{L}", "?[A-Za-z]").replace("?\\p{N}", "?[0-9]").replace("\\p{L}\\p{N}", "A-Za-z0-9")
        self.ascii_parts = re.compile(ascii_rule, re.ASCII).findall
        # the same rule for Latin-1, its classes spelled out
        latin = [chr(c) for c in range(256)]
        letter, number, blank = ("".join(re.escape(c) for c in latin if f(c)) for f in (lambda c: unicodedata.category(c)[0] == "L", lambda c: unicodedata.category(c)[0] == "N", lambda c: c in "\t\n\v\f\r \x85\xa0"))
        latin_rule = ascii_rule.replace("A-Za-z", letter).replace("0-9", number).replace("\\S", f"[^{blank}]").replace("[^\\s", f"[^{blank}").replace("\\s", f"[{blank}]")
        self.latin_parts = re.compile(latin_rule).findall
        spelled = byte_letters()
        self.letters = {c: "".join(spelled[b] for b in chr(c).encode()) for c in range(256) if chr(c) != "\n"}
        self.cut = self.cut_at_spaces if cut == "space" else self.cut_words
        self.clear()

    MARK = "\x01"
    #: White space (or MARK) in a text that Arrow's quick cuts don't treat as the rule asks.
    ODD_TEXT = {
        "space": r"[ \n]{2}|^[ \n]|[ \n]$|[\t\r\x0b\x0c\x1c-\x1f\x01]|[\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]",
        "word": r"\x01",
    }
    EVEN_CUTS = re.compile(r"(?<=\S)(?=[ \n]\S)").split
    ODD_BLANK = re.compile("[\x85\xa0]").search
    ODD_SPACE = re.compile(r"[^\S \t\n\r\f\v]|[\x1c-\x1f]").search
    WORDS = re.compile(r"[^ \t\n\r\f\v]+").findall

    def cut_at_spaces(self, text: str) -> list[str]:
        """Keys of the pieces: a piece after a space without that space, any other with MARK before it."""
        words = text.split()
        single = len(text) - len(words) + 1 == len("".join(words)) and text.count(" ") + text.count("\n") == len(words) - 1
        if not single or self.MARK in text:  # runs of white space, or other than spaces and line ends
            return [p[1:] if p[:1] == " " and p[1:2] != self.MARK else self.MARK + p for p in self.EVEN_CUTS(text)]
        return (self.MARK + text.replace("\n", " \x01\n")).split(" ") if text else []

    def cut_words(self, text: str) -> list[str]:
        """Keys of the words, which are the words with MARK before those that begin with it."""
        words = self.WORDS(text) if self.ODD_SPACE(text) else text.split()
        return [self.MARK + w if w[0] == self.MARK else w for w in words] if self.MARK in text else words

    def piece(self, key: str) -> str:
        """The text that a key stands for."""
        if key[:1] == self.MARK:
            return key[1:]
        return " " + key if self.cut == self.cut_at_spaces else key

    def clear(self) -> None:
        self.places: dict[str, int] = {}
        self.parts: dict[str, bytes] = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.begin = np.zeros(1 << 12, np.int64)
        self.hits = np.zeros(1 << 12, np.int64)
        self.used = 0

    def forget_rare(self) -> None:
        """Keep the pieces met most often, half of MOST_KEPT at most."""
        keys, hits = list(self.places), self.hits[: len(self.places)]
        least = max(2, int(np.partition(hits, -MOST_KEPT // 2)[-MOST_KEPT // 2]) + 1)
        keep = np.flatnonzero(hits >= least)
        begin = self.begin[keep]
        size = self.begin[keep + 1] - begin
        ends = np.cumsum(size)
        ids = self.ids[np.arange(int(size.sum())) + np.repeat(begin - ends + size, size)]
        self.clear()
        self._store([keys[i] for i in keep.tolist()], ids, size)

    def _parts(self, piece: str) -> list[str]:
        """The split parts of a piece by the library's own normaliser and splitter."""
        return [x for x, _ in self.split(self.normalise(piece) if self.normalise else piece)]

    def _parts_of_all(self, keys: list[str], rule) -> tuple[list[str], np.ndarray]:
        """All parts of keys without white space, and how many each key has: the keys are split as one text, as a part
        never goes on after a space. The rule is the library's in Python, for ASCII or Latin-1, which is quicker.
        """
        lead = "" if self.cut == self.cut_words else " "
        text = lead + " ".join(keys)
        parts = rule(text.lower() if self.normalise else text)
        length = np.fromiter(map(len, keys), np.int64, len(keys)) + len(lead)
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        count = np.diff(np.searchsorted(ends, np.cumsum(length), side="right"), prepend=0)
        return "\n".join(parts).translate(self.letters).split("\n"), count

    def _add(self, keys: list[str]) -> None:
        """Encode new pieces by the library's own model, keeping the ids of each split part."""
        plain = [k for k in keys if k[:1] != self.MARK and len(k.split()) == 1 and k == k.strip()]
        ascii_keys = [k for k in plain if k.isascii()]
        latin_keys = [k for k in plain if not k.isascii() and max(k) < "\u0100" and not self.ODD_BLANK(k)]
        for some, rule in ((ascii_keys, self.ascii_parts), (latin_keys, self.latin_parts)):
            if some:
                self._keep(some, *self._parts_of_all(some, rule))
        rest = [k for k in keys if k not in self.places]
        if rest:
            split = [self._parts(self.piece(k)) for k in rest]
            self._keep(rest, list(chain.from_iterable(split)), np.fromiter(map(len, split), np.int64, len(split)))

    def _keep(self, keys: list[str], parts: list[str], count: np.ndarray) -> None:
        """Store the ids of keys from their parts, the next count[i] of which are the ith key's."""
        model, known = self.model, self.parts
        for part in dict.fromkeys(parts):
            if part not in known:
                known[part] = array("i", [t.id for t in model(part)]).tobytes()
        flat = [known[p] for p in parts]
        ends = np.cumsum(np.fromiter(map(len, flat), np.int64, len(flat))) // 4
        self._store(keys, np.frombuffer(b"".join(flat), np.int32), np.diff(np.append(0, ends)[np.cumsum(count)], prepend=0))

    def _store(self, keys: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        k = len(self.places)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while k + len(keys) >= len(self.begin):
            self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
            self.hits = np.concatenate([self.hits, np.zeros_like(self.hits)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.begin[k + 1 : k + 1 + len(keys)] = self.used + np.cumsum(sizes)
        self.used += len(ids)
        self.places.update(zip(keys, range(k, k + len(keys)), strict=True))

    def encode_column(self, texts: pa.Array, with_ids: bool = True) -> tuple[np.ndarray | None, np.ndarray]:
        """As encode(), of a column without nulls. Arrow cuts the texts and finds the distinct pieces of all of them, so
        Python sees a piece once; texts with odd white space or added tokens go through encode()."""
        texts = texts.cast(pa.string())
        if self.by_library:
            return self.encode(texts.to_pylist())
        odd = pc.match_substring_regex(texts, self.ODD_TEXT["word" if self.cut == self.cut_words else "space"])
        for token in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, token))
        odd = odd.to_numpy(zero_copy_only=False)
        if not odd.any():
            return self._encode_plain(texts, with_ids)
        sizes = np.zeros(len(texts), np.int64)
        ids, sizes[~odd] = self._encode_plain(texts.filter(pa.array(~odd)), with_ids)
        more, sizes[odd] = self.encode(texts.filter(pa.array(odd)).to_pylist())
        if not with_ids:
            return None, sizes
        # where each text's ids begin in the plain and in the odd ones, one behind the other
        begin = np.where(odd, len(ids) + np.cumsum(sizes * odd) - sizes, np.cumsum(sizes * ~odd) - sizes)
        ends = np.cumsum(sizes)
        return np.concatenate([ids, more])[np.arange(len(ids) + len(more)) + np.repeat(begin - ends + sizes, sizes)], sizes

    def _encode_plain(self, texts: pa.Array, with_ids: bool) -> tuple[np.ndarray | None, np.ndarray]:
        if len(self.places) > MOST_KEPT:
            self.forget_rare()
        if self.cut == self.cut_words:
            cut = pc.ascii_split_whitespace(texts)
        else:
            cut = pc.split_pattern(pc.binary_join_element_wise(self.MARK, pc.replace_substring(texts, "\n", f" {self.MARK}\n"), ""), " ")
        found = cut.flatten().dictionary_encode()
        keys = found.dictionary.to_pylist()
        place = np.fromiter(map(self.places.get, keys, repeat(-1)), np.int64, len(keys))
        missing = np.flatnonzero(place < 0).tolist()
        if missing:
            fresh = [keys[i] for i in missing]
            self._add(fresh)
            place[missing] = [self.places[k] for k in fresh]
        self.hits[place] += 1
        at = found.indices.to_numpy()
        size = (self.begin[place + 1] - self.begin[place])[at]
        ends = np.cumsum(size)
        bounds = np.append(0, ends)[np.append(0, np.cumsum(pc.list_value_length(cut).to_numpy()))]
        ids = None
        if with_ids:
            ids = self.ids[np.arange(int(bounds[-1])) + np.repeat(self.begin[place][at] - ends + size, size)]
        if missing and max(map(len, fresh)) > LONGEST_KEPT:
            self.clear()
        return ids, np.diff(bounds)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and how many each text has."""
        if self.by_library:
            found = [self.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
            return np.fromiter(chain.from_iterable(found), np.int32), np.fromiter(map(len, found), np.int64, len(found))
        if not any(a in t for a in self.added for t in texts):
            return self._encode(texts)
        # text, added token, text, ... of each text
        split = [self.at_added(t) for t in texts]
        ids, sizes = self._encode([x for parts in split for x in parts[::2]])
        count = np.array([len(parts) // 2 + 1 for parts in split])
        last = np.zeros(len(sizes), bool)
        last[np.cumsum(count) - 1] = True
        ids = np.insert(ids, np.cumsum(sizes)[~last], [self.added[x] for parts in split for x in parts[1::2]])
        return ids, np.add.reduceat(sizes, np.cumsum(count) - count) + count - 1

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.places) > MOST_KEPT:
            self.forget_rare()
        cut = [self.cut(t) for t in texts]
        keys = list(chain.from_iterable(cut))
        index = np.fromiter(map(self.places.get, keys, repeat(-1)), np.int64, len(keys))
        missing = np.flatnonzero(index < 0).tolist()
        if missing:
            fresh = list(dict.fromkeys(keys[i] for i in missing))
            self._add(fresh)
            index[missing] = [self.places[keys[i]] for i in missing]
        self.hits[index] += 1  # once for each piece: what counts is how many batches hold it
        begin = self.begin[index]
        size = self.begin[index + 1] - begin
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.arange(total) + np.repeat(begin - ends + size, size)]
        per_text = np.cumsum([0, *map(len, cut)])
        bounds = np.append(0, ends)[per_text]
        if missing and max(map(len, fresh)) > LONGEST_KEPT:
            self.clear()
        return ids, np.diff(bounds)


def encoder(path: str, cut: str, added: bool = False) -> Encoder:
    """The worker's encoder of a tokenizer file, loaded once."""
    if (path, cut, added) not in _loaded:
        _loaded[path, cut, added] = Encoder(path, cut, added)
    return _loaded[path, cut, added]
