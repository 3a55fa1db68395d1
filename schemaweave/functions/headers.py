"""Header normalisation on the driver: headers and target names are few."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby, pairwise

from ..model import fingerprint

#: Portuguese header abbreviations: fixed values.
PT_BR = {"dt": "data", "nasc": "nascimento", "tel": "telefone", "cel": "celular", "end": "endereco", "cod": "codigo", "cli": "cliente"}
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2008\u2009\u200a\u2028\u2029\u205f\u3000"


@dataclass(frozen=True)
class Header:
    original: str
    comparable: str
    tokens: tuple[str, ...]
    compact: str


#: Classes of neighbouring ASCII characters between which a word ends: camel case, and letters beside digits.
CUTS = {"lu", "du", "ld", "ud", "dl"}


def _class(char: str) -> str:
    return "l" if "a" <= char <= "z" else "u" if "A" <= char <= "Z" else "d" if "0" <= char <= "9" else "-"


def words_of(text: str) -> Iterator[str]:
    """Runs of ASCII letters and digits, cut where their class changes, in lower case and without accents."""
    classes = [_class(c) for c in text]
    ends = [k + 1 for k, two in enumerate(zip(classes, classes[1:], strict=False)) if "".join(two) in CUTS]
    for start, end in pairwise([0, *ends, len(text)]):
        parts = unicodedata.normalize("NFD", text[start:end].lower())
        base = (c for c in parts if unicodedata.category(c)[0] != "M")
        for plain, run in groupby(base, lambda c: c.isascii() and c.isalnum()):
            if plain:
                yield "".join(run)


@dataclass(frozen=True)
class HeaderNormalizer:
    """``expansions`` give the word, or the list of words, that a word stands for."""

    expansions: dict[str, str | list[str]] = field(default_factory=dict)

    def __call__(self, header: str | None) -> Header:
        said = header or ""
        words: list[str] = []
        for word in words_of(unicodedata.normalize("NFKC", said).strip(WHITE)):
            full = self.expansions.get(word, word)
            words += full.split() if isinstance(full, str) else [w for part in full for w in part.split()]
        return Header(said, " ".join(words), tuple(words), "".join(words))

    @property
    def fingerprint(self) -> str:
        return fingerprint("normalizer", self.expansions)
