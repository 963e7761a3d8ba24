"""Cost of guessing a password: the cheapest way to cut it into words, dates, repeats, keyboard walks and the rest.

A guesser who knows these patterns needs, for one cut into n spans, the
product of the spans' guesses times n! for their order.  The cost is the
smallest of these products, found by dynamic programming over the places
where a pattern starts or ends; cutting a brute-force span elsewhere never
makes it cheaper.
"""

from __future__ import annotations

import re
from math import inf, lgamma, log, log10

# Common passwords, placeholders and parts of them; earlier ones are guessed first.
COMMON = (
    "password passwd pass secret token admin login root user test guest default changeme example sample dummy "
    "welcome letmein qwerty azerty dragon monkey shadow master sunshine princess football baseball iloveyou trustno "
    "abc love god hello summer winter spring autumn monday friday january july december server database oracle "
    "mysql postgres apple google amazon azure cloud docker linux windows ubuntu company office internet computer "
    "system service account customer public private key value string none null true false empty here your my the "
    "this that insert replace enter todo fixme redacted removed hidden foo bar baz demo temp temporary new old "
    "super man bat girl boy king queen star silver gold black white red green blue orange happy lucky magic "
    "secure security access auth bearer basic client api app web site home work family friend baby angel michael "
    "jordan thomas robert daniel george andrew jessica ashley nicole hunter ranger tiger lion eagle wolf killer "
    "cheese cookie banana pepper ginger coffee chocolate freedom whatever nothing"
).split()

_ROWS = ("`1234567890-=", " qwertyuiop[]\\", " asdfghjkl;'", " zxcvbnm,./")
_LEET = str.maketrans("4@301!$57", "aaeoiisst")
_DATE = re.compile(r"(\d{1,4})([-/._]?)(\d{1,2})\2(\d{1,4})")
_LONGEST = max(map(len, COMMON))


def _neighbours() -> dict[str, frozenset[str]]:
    place = {key: (x + 0.5 * y, y) for y, row in enumerate(_ROWS) for x, key in enumerate(row) if key != " "}
    return {a: frozenset(b for b, (u, v) in place.items() if b != a and abs(u - x) <= 1 and abs(v - y) <= 1)
            for a, (x, y) in place.items()}


_NEXT = _neighbours()
_DEGREE = sum(map(len, _NEXT.values())) / len(_NEXT)


def _variations(span: str) -> float:
    """Guesses for the capitals of a word."""
    if span.islower() or not any(map(str.isupper, span)):
        return 0.0
    if span.isupper() or span[0].isupper() and not any(map(str.isupper, span[1:])):
        return log10(2)
    up, n = sum(map(str.isupper, span)), len(span)
    return log10(sum(_choose(n, k) for k in range(1, min(up, n - up) + 1)) or 2)


def _choose(n: int, k: int) -> float:
    return round(2.718281828459045 ** (lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)))


def _words(text: str, ranks: dict[str, int]):
    lower = text.lower()
    plain = lower.translate(_LEET)
    for i in range(len(text)):
        for j in range(i + 3, min(len(text), i + _LONGEST) + 1):
            span = text[i:j]
            if (rank := ranks.get(lower[i:j])) is not None:
                yield i, j, log10(rank) + _variations(span)
            elif (rank := ranks.get(plain[i:j])) is not None:
                yield i, j, log10(rank) + log10(2) + _variations(span)
            elif (rank := ranks.get(lower[i:j][::-1])) is not None:
                yield i, j, log10(rank) + log10(2) + _variations(span)


def _dates(text: str):
    for i in range(len(text)):
        for j in range(i + 4, min(len(text), i + 10) + 1):
            m = _DATE.fullmatch(text, i, j)
            if m is None:
                continue
            a, b, c = int(m[1]), int(m[3]), int(m[4])
            if len(m[1]) == 4 or len(m[4]) == 4:
                year, day, month = (a, b, c) if len(m[1]) == 4 else (c, a, b)
                full = 1900 <= year <= 2050
            else:
                year, day, month, full = 2000, a, b, len(m[1]) <= 2 and len(m[4]) == 2
            if full and 1 <= min(day, month) <= 12 and 1 <= max(day, month) <= 31:
                yield i, j, log10(365 * max(abs(year - 2020), 20)) + (log10(4) if m[2] else 0)


def _repeats(text: str, rest: int):
    """Runs of one unit; ``rest`` is the size of the alphabet that a unit's characters come from."""
    i = 0
    while i < len(text):
        best = None
        for unit in range(1, min(8, (len(text) - i) // 2) + 1):
            n = 1
            while text[i + n * unit:i + (n + 1) * unit] == text[i:i + unit]:
                n += 1
            if n > 1 and n * unit >= 3 and (best is None or n * unit > best[0]):
                best = (n * unit, unit, n)
        if best:
            yield i, i + best[0], best[1] * log10(rest) + log10(best[2])
            i += best[0] - best[1]
        i += 1


def _walks(text: str):
    lower, i = text.lower(), 0
    while i < len(lower):
        j, turns, way = i + 1, 1, None
        while j < len(lower) and lower[j] in _NEXT.get(lower[j - 1], ()):
            now = ord(lower[j]) - ord(lower[j - 1])
            turns += way is not None and now != way
            way, j = now, j + 1
        if j - i >= 4:
            n = j - i
            yield i, j, log10(sum(_choose(n - 1, t - 1) for t in range(1, turns + 1)) * len(_NEXT)) + turns * log10(_DEGREE)
            i = j - 1
        i += 1


def _alphabet(text: str) -> int:
    """Characters that a brute-force guesser has to try at each place."""
    size = 10 * any(c.isdigit() for c in text) + 26 * any("a" <= c <= "z" for c in text)
    size += 26 * any("A" <= c <= "Z" for c in text)
    other = {c for c in text if not (c.isascii() and c.isalnum())}
    return max(size + (33 if other else 0) + (100 if any(ord(c) > 127 for c in other) else 0), 10)


def word_ranks(words=COMMON) -> dict[str, int]:
    return {w: k + 1 for k, w in reversed(list(enumerate(words)))}


_RANKS = word_ranks()


def spans_of(text: str, rest: int, ranks: dict[str, int] = _RANKS) -> list[tuple[int, int, float]]:
    """(start, end, log10 of the guesses) of every pattern in a text; ``rest`` is its alphabet's size."""
    return [*_words(text, ranks), *_dates(text), *_repeats(text, rest), *_walks(text)]


def log10_guesses(text: str, ranks: dict[str, int] = _RANKS) -> float:
    """log10 of the guesses of the cheapest cut into any number of spans; 0 for an empty text.

    One layer for each number of spans, of a few steps for each pattern and
    place: the cheapest brute-force span up to a place comes from a running
    minimum.  Layers end when their orders alone cost more than is left to gain
    over the cheapest cut whose orders are free, so no cut is left out.
    """
    n = len(text)
    if not n:
        return 0.0
    rest = _alphabet(text)
    each = log10(rest)
    spans = spans_of(text, rest, ranks)
    places = sorted({0, n, *(i for i, _, _ in spans), *(j for _, j, _ in spans)})
    at = {p: k for k, p in enumerate(places)}
    arriving: list[list[tuple[int, float]]] = [[] for _ in places]
    for i, j, cost in spans:
        arriving[at[j]].append((at[i], cost))
    free = [0.0]
    for k in range(1, len(places)):
        free.append(min([free[k - 1] + (places[k] - places[k - 1]) * each, *(free[m] + cost for m, cost in arriving[k])]))
    layer = [0.0] + [inf] * (len(places) - 1)
    cheapest, used = inf, 0
    while used < n and free[-1] + lgamma(used + 2) / log(10) < cheapest:
        used += 1
        after, least = [inf], inf
        for k in range(1, len(places)):
            least = min(least, layer[k - 1] - places[k - 1] * each)
            after.append(min([least + places[k] * each, *(layer[m] + cost for m, cost in arriving[k])]))
        layer = after
        cheapest = min(cheapest, layer[-1] + lgamma(used + 1) / log(10))
    return cheapest
