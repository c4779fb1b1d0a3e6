"""Splitting text into the units that a tokenizer merges on their own, and remembering each unit's ids.

A unit's ids do not depend on its neighbours, so a text's ids are its units' ids in order. Units are found with the
standard library's regular expressions over a set of code points for which the tests hold the split against the
tokenizers library, one code point at a time; a text with any other code point goes to the library whole.

Units between two spaces are remembered together. A space is a cut before it, if what is behind or before it is no white
space; a text where that fails for some space is cut by the pattern as a whole.

New units are merged by tiktoken, which takes a fraction of the library's time for a word. It merges any two tokens that
together are a token, the library only the pairs that its file lists. That is the same if the order of the merges is that of
the ranks, and each token's own encoding by the merges before its own are the two halves that the file has: whenever
neighbours make a token, they are where that token's own encoding was before its last merge. The file is tested for it; one
that fails stays with the library.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable
from functools import cache

#: Latin letters that lower-case within the set, general punctuation, the euro and trade mark signs.
KNOWN = [*range(0x180), *range(0x2010, 0x2028), 0x20AC, 0x2122]
#: Lower-casing this one gives a letter and a combining mark, which the set does not hold.
KNOWN.remove(0x130)


def _ranges(points: list[int]) -> str:
    runs: list[list[int]] = []
    for p in points:
        if runs and runs[-1][1] == p - 1:
            runs[-1][1] = p
        else:
            runs.append([p, p])
    return "".join(rf"\u{a:04x}-\u{b:04x}" for a, b in runs)


def _of(kind: str) -> str:
    return _ranges([p for p in KNOWN if unicodedata.category(chr(p)).startswith(kind)])


LETTER, NUMBER, BLANK = _of("L"), _of("N"), r"\t-\r \x85\xa0"
#: The split patterns that the two vocabulary files name, with explicit classes.
BYTE_UNIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{BLANK}{LETTER}{NUMBER}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+"
WORD_UNIT = rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^{BLANK}{LETTER}{NUMBER}]+"


@cache
def known_text() -> re.Pattern:
    return re.compile(rf"[{_ranges(sorted(KNOWN))}]*")


def is_known(text: str) -> bool:
    return text.isascii() or known_text().fullmatch(text) is not None


#: A space that need not be a cut.
NO_CUT = re.compile(rf"[{BLANK}] (?:[{BLANK}]|\Z)")
#: Ends a unit of a vocabulary that marks ends of words; no unit holds it.
END = "\n"


class Known(dict):
    """What make() gives for each key, remembered for at most `entries` keys."""

    def __init__(self, make: Callable, entries: int):
        super().__init__()
        self.make, self.entries = make, entries

    def __missing__(self, key: str):
        if len(self) >= self.entries:
            self.clear()
        self[key] = made = self.make(key)
        return made


@cache
def byte_alphabet() -> dict[str, int]:
    """The letters that stand for bytes: printable ones for themselves, the others from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def halves(token: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The token's encoding by the merges before its own."""
    parts, own = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while True:
        found = min(((ranks.get(a + b, own), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(own, 0))
        if found[0] >= own:
            return parts
        at = found[1]
        parts[at : at + 2] = [parts[at] + parts[at + 1]]


def _merges(path: str) -> tuple[dict[bytes, int], list[int], list[tuple[bytes, bytes]], bool] | None:
    """Ranks of a byte-level file's tokens, the file's id of each rank, the pairs that it lists, and whether it marks ends of
    words; nothing if a part of it has no like in ranks."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
        return None
    suffix, letters, vocab = model.get("end_of_word_suffix") or "", byte_alphabet(), model["vocab"]
    symbols = {c: bytes([b]) for c, b in letters.items()}
    if suffix:
        symbols |= {c + suffix: bytes([b]) + END.encode() for c, b in letters.items() if chr(b) != END}
    ranks = {x: k for k, x in enumerate(symbols.values())}
    ids = [vocab.get(c) for c in symbols]
    pairs = []

    def plain(name: str) -> bytes:
        if suffix and name.endswith(suffix):
            return bytes(letters[c] for c in name.removesuffix(suffix)) + END.encode()
        return bytes(letters[c] for c in name)

    try:
        for pair in model["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            pairs.append((plain(a), plain(b)))
            if (token := b"".join(pairs[-1])) in ranks:
                return None
            ranks[token] = len(ids)
            ids.append(vocab[a + b])
    except KeyError:
        return None
    return (ranks, ids, pairs, bool(suffix)) if None not in ids else None


@cache
def by_ranks(path: str) -> bool:
    """Whether tiktoken merges as the file says: see the module's text."""
    found = _merges(path)
    return found is not None and all(halves(a + b, found[0]) == [a, b] for a, b in found[2])


class Ranked:
    """The file's ids of a text's units by tiktoken. The text's code points are known ones."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        ranks, self.ids, _, self.ends = _merges(path)
        self.units = re.compile(pattern).findall
        own = tiktoken.Encoding("units", pat_str=rf"[^{END}]+{END}" if self.ends else pattern, mergeable_ranks=ranks, special_tokens={})
        self.ranks = own.encode_ordinary

    def encode(self, text: str) -> list[int]:
        if self.ends:
            text = "".join([u + END for u in self.units(text)])
        table = self.ids
        return [table[k] for k in self.ranks(text)]


class UnitIds:
    """The ids of units, as make() packs them; at most `entries` units are remembered."""

    def __init__(self, tokenizer, pattern: str, make, entries: int = 1 << 19):
        self.tokenizer, self.make, self.entries = tokenizer, make, entries
        self.units = re.compile(pattern).findall
        self.known: dict[str, object] = {}

    def of_units(self, units: list[str]) -> list:
        known = self.known
        try:
            return [known[u] for u in units]
        except KeyError:
            new = list({u for u in units if u not in known})
        if len(known) + len(new) > self.entries:
            known.clear()
            new = list(set(units))
        for u, e in zip(new, self.tokenizer.encode_batch(new, add_special_tokens=False), strict=True):
            known[u] = self.make(e.ids)
        return [known[u] for u in units]


def load(path: str, special_as_text: bool = False):
    """The tokenizer of a vocabulary file, without truncation and padding, on one thread."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    t.encode_special_tokens = special_as_text
    return t
