"""File names made by a rule: scripts, separators, lengths and extensions, from a seed."""

import random
import re

HAN = [chr(c) for c in range(0x5C0F, 0x5C0F + 600, 7)]
LATIN = "bcdfghklmnprstvz"
VOWELS = "aeiou"
SEPARATORS = ["_", "-", " ", ".", "(", "@", "#"]
EXTENSIONS = ["", "txt", "tar.gz", "x1", "D"]


def word(rng: random.Random, script: str) -> str:
    if script == "han":
        return "".join(rng.choices(HAN, k=rng.randint(1, 5)))
    letters = "".join(rng.choice(LATIN) + rng.choice(VOWELS) for _ in range(rng.randint(1, 4)))
    return rng.choice([letters, letters.title(), letters.upper(), f"{letters}{rng.randint(0, 99)}"])


def names(seed: int, n: int, longest: int = 6) -> list[str]:
    """Distinct names; about a third mix both scripts."""
    rng, out = random.Random(seed), {}
    while len(out) < n:
        script = rng.choice(["latin", "han", "mixed"])
        words = [word(rng, rng.choice(["latin", "han"]) if script == "mixed" else script) for _ in range(rng.randint(1, longest))]
        name = words[0] + "".join(rng.choice(SEPARATORS) + w for w in words[1:])
        extension = rng.choice(EXTENSIONS)
        out[f"{name}.{extension}" if extension else name] = None
    return list(out)


def is_han(c: str) -> bool:
    return "一" <= c <= "鿿"


def pieces(run: str) -> list[str]:
    """Runs of Han as overlapping pairs, other runs whole."""
    parts = re.findall(r"[一-鿿]+|[^一-鿿]+", run)
    return [t for p in parts for t in ([p[i : i + 2] for i in range(max(len(p) - 1, 1))] if is_han(p[0]) else [p])]


def route(name: str) -> str:
    letters = [c for c in name if c.isalpha()]
    han = sum(map(is_han, letters))
    return "cmn" if han and 2 * han >= len(letters) else "other"


def tokens(name: str) -> list[str]:
    """What the mixed tokenizer is to give."""
    runs = re.findall(r"[^\W_]+", name)
    return [t for run in runs for t in pieces(run)] if route(name) == "cmn" else runs
