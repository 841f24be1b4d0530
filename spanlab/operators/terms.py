"""Where many phrases or passages stand in a text, all in one pass (Aho-Corasick), whatever their number."""

from __future__ import annotations

import ahocorasick


def folded(text: str) -> str:
    """Lower case of the same length: a character whose lower case is longer stays as it is."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _is_word(text: str, at: int, start: int, end: int) -> bool:
    return start <= at < end and (text[at].isalnum() or text[at] == "_")


def is_whole(text: str, at: int, to: int, start: int = 0, end: int | None = None) -> bool:
    """Do words begin or end at both ends of [at, to), in the part [start, end) of a text?"""
    end = len(text) if end is None else end
    return all(_is_word(text, x - 1, start, end) != _is_word(text, x, start, end) for x in (at, to))


class Phrases:
    """Phrases to be found in any case. Empty ones are never found."""

    def __init__(self, phrases: list[str]):
        self.phrases = [*dict.fromkeys(p for p in phrases if p)]
        self.machine = ahocorasick.Automaton()
        for number, phrase in enumerate(self.phrases):
            same = self.machine.get(folded(phrase), ())
            self.machine.add_word(folded(phrase), (*same, number))
        if self.phrases:
            self.machine.make_automaton()

    def finds(self, text: str) -> list[tuple[int, int]]:
        """(start, number of the phrase) of every find, within words too, by its end."""
        if not self.phrases:
            return []
        found = self.machine.iter(folded(text))
        return [(last + 1 - len(self.phrases[n]), n) for last, numbers in found for n in numbers]

    def places(self, text: str) -> list[tuple[int, int]]:
        """Those at whose ends words begin or end."""
        return [(at, n) for at, n in self.finds(text) if is_whole(text, at, at + len(self.phrases[n]))]


#: Characters of a passage's start by which its places are found.
ANCHOR = 32


class Passages:
    """Passages to be found as they are. A text is passed over once for the starts of all of them; what follows a start is
    compared there alone. Empty ones are never found."""

    def __init__(self, passages: list[str]):
        self.numbers: dict[str, list[int]] = {}
        for number, passage in enumerate(passages):
            if passage:
                self.numbers.setdefault(passage, []).append(number)
        self.machine = ahocorasick.Automaton()
        for passage in self.numbers:
            same = self.machine.get(passage[:ANCHOR], ())
            self.machine.add_word(passage[:ANCHOR], (*same, passage))
        if self.numbers:
            self.machine.make_automaton()

    def first(self, text: str) -> list[tuple[int, int]]:
        """(number of the passage, start) of the first place of each that the text holds."""
        found: dict[str, int] = {}
        if self.numbers:
            for last, passages in self.machine.iter(text):
                for passage in passages:
                    at = last + 1 - min(len(passage), ANCHOR)
                    if passage not in found and text.startswith(passage, at):
                        found[passage] = at
        return [(number, at) for passage, at in found.items() for number in self.numbers[passage]]
