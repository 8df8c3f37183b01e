"""URL filters: host rules first, then a weighted vocabulary found by Aho-Corasick.

A term counts where no letter or digit touches it on either side. Strict terms weigh as much
as a rejection, soft ones half, and a soft term counts once however often it comes; a URL is
blocked when the weights of its different terms reach ``LIMIT``. The longest rule whose host
is the URL's or above it, and whose path the URL's begins with, goes before the vocabulary.

A null URL, or one without ``://``, has an empty host and path, fits no rule and is allowed
unless its text holds terms (a null has none). The rules and terms are parameters and are
broadcast; a host is looked up with those above it, so a lookup takes as long with a hundred
thousand rules as with four. Nothing is shuffled; rows, repeated and very long ones too, are
judged one by one. Columns with names of the results give way to them.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from factorlab.llm.common import add_columns, values

LIMIT = 2
STRICT = ("porn", "xxx", "sex", "casino", "viagra", "pills", "escort", "nude", "hentai", "malware", "phishing", "warez")
SOFT = ("adult", "ads", "bet", "bets", "betting", "bonus", "cheap", "click", "dating", "farm", "free", "gambling", "loan",
        "poker", "spam", "slots", "track", "tracker", "win", "x")
TERMS = {term: LIMIT for term in STRICT} | {term: 1 for term in SOFT}
_ALNUM = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    path = rest[end:]
    stop = min((path.find(c) for c in "?#" if c in path), default=len(path))
    return _lower(rest[:end]), path[:stop]


def _lower(text: str) -> str:
    return text.lower() if text.isascii() else "".join(c.lower() if c.isascii() else c for c in text)


def automaton(terms: dict[str, int]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for term in terms:
        found.add_word(term, term)
    if terms:
        found.make_automaton()
    return found


def terms_in(text: str, found: ahocorasick.Automaton) -> set[str]:
    """Different terms of ``text`` (lower case) that stand alone."""
    if not len(found):
        return set()
    hits = set()
    for last, term in found.iter(text):
        first = last - len(term) + 1
        if (not first or text[first - 1] not in _ALNUM) and (last + 1 == len(text) or text[last + 1] not in _ALNUM):
            hits.add(term)
    return hits


class Rules:
    """Rules by their hosts and the lengths of their paths, so that a lookup does not grow with their number."""

    def __init__(self, rules: dict[str, str]):
        self.by_host: dict[str, tuple[list[int], dict[str, str]]] = {}
        for rule in rules:
            domain, slash, start = rule.partition("/")
            lengths, paths = self.by_host.setdefault(domain, ([], {}))
            paths[slash + start] = rule
            if len(slash + start) not in lengths:
                lengths.append(len(slash + start))
        for lengths, _ in self.by_host.values():
            lengths.sort(reverse=True)
        self.longest = max(map(len, self.by_host), default=-1)

    def best(self, host: str, path: str) -> str | None:
        """The longest rule that fits: its host or one below it, and the beginning of the path."""
        best, at = None, 0
        if len(host) > self.longest:  # no rule's host is as long: on to the first dot from where one can be
            at = host.find(".", len(host) - self.longest - 1) + 1 or -1 if self.longest >= 0 else -1
        while at >= 0:  # the host, then what follows each of its dots
            lengths, paths = self.by_host.get(host[at:], ((), {}))
            for n in lengths:
                rule = paths.get(path[:n]) if n <= len(path) else None
                if rule is not None:
                    if best is None or (len(rule), rule) > (len(best), best):
                        best = rule
                    break
            at = host.find(".", at) + 1 or -1
        return best


def best_rule(host: str, path: str, rules: dict[str, str]) -> str | None:
    return Rules(rules).best(host, path)


def judge(pages: DataFrame, rules: dict[str, str], terms: dict[str, int] = TERMS, url_col: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``verdict`` and the ``terms`` found."""
    shared = pages.sparkSession.sparkContext.broadcast((dict(rules), dict(terms)))
    made: list[tuple[Rules, ahocorasick.Automaton]] = []  # one for each task

    def judged(columns):
        known, weights = shared.value
        if not made:
            made.append((Rules(known), automaton(weights)))
        (lookup, found), rows = made[0], []
        for url in values(columns[0]):
            host, path = split_url(url)
            hits = sorted(terms_in(_lower(url or ""), found))
            rule = lookup.best(host, path)
            verdict = known[rule] if rule else "block" if sum(weights[t] for t in hits) >= LIMIT else "allow"
            rows.append((host, path, rule, verdict, hits))
        columns_ = list(zip(*rows)) or [()] * 5
        return [pa.array(c, pa.string()) for c in columns_[:4]] + [pa.array(columns_[4], pa.list_(pa.string()))]

    return add_columns(pages, [url_col], "host string, path string, rule string, verdict string, terms array<string>", judged)
