"""Made-up prose for the tests."""

WORDS = [f"{a}{b}{c}" for a in ("th", "er", "on", "sta") for b in ("an", "in", "el") for c in ("d", "t", "ra", "s")]


def prose(rnd, n):
    out = []
    while len(out) < n:
        size = rnd.randint(5, 14)
        sentence = [rnd.choice(WORDS) + rnd.choice(WORDS) for _ in range(size)]
        out += [sentence[0].capitalize(), *sentence[1:-1], sentence[-1] + "."]
    return " ".join(out[:n])


ITEM = "Ann has 3 red apples in her old basket and then gives 3 of them to Bob before walking 5 miles home with the rest"
