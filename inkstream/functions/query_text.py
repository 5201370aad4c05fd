"""The search box grammar: phrases in quotes are all required, of the bare words one is; the last bare word is a prefix."""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Term:
    """One query term: the words of a phrase, or one word that may be a prefix."""

    words: tuple[str, ...]
    phrase: bool = False
    prefix: bool = False

    def text(self) -> str:
        if self.phrase or self.words == ("OR",):
            return '"' + " ".join(self.words) + '"'
        return self.words[0] + "*" * self.prefix


@dataclass(frozen=True)
class Parsed:
    phrases: tuple[Term, ...]
    words: tuple[Term, ...]

    @property
    def terms(self) -> tuple[Term, ...]:
        return self.phrases + self.words

    def text(self) -> str:
        """The canonical match string."""
        any_word = " OR ".join(w.text() for w in self.words)
        if not self.phrases:
            return any_word
        return " AND ".join([*(p.text() for p in self.phrases), *([f"({any_word})"] if any_word else [])])


def parse_query(text: str) -> Parsed:
    phrases, words, last_bare = [], [], False
    for i, part in enumerate(text.split('"')):
        found = re.findall(r"[A-Za-z0-9]+", part)
        if i % 2:
            inner = " ".join(part.split())
            if inner:
                phrases.append(Term(tuple(inner.split(" ")), phrase=True))
                last_bare = False
        elif found:
            words += [Term((w,)) for w in found]
            last_bare = True
    if words and last_bare and words[-1].words != ("OR",):
        words[-1] = Term(words[-1].words, prefix=True)
    return Parsed(tuple(phrases), tuple(words))


def candidate_limit(n: int) -> int:
    return min(2000, 3 * n + 20)


def split_uris(raw: str, most: int = 25) -> list[str]:
    out = [x.strip() for x in raw.split(",") if x.strip()]
    if len(out) > most:
        raise ValueError(f"at most {most} uris")
    return out


def normalized_query(raw: str) -> str | None:
    q = raw.strip()
    q = "".join(c.lower() if c.isascii() else c for c in q)
    return q if len(q.encode()) >= 2 else None


def effective_mode(query: str, mode: str) -> str:
    """Without text there is nothing to embed: such requests browse by keyword."""
    return mode if query.strip() else "keyword"


def passes_since(created_at: str, since: str | None) -> bool:
    return not since or bool(created_at) and created_at >= since
