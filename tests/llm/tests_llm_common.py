"""What the tests of this folder share."""

WORDS = "river stone cloud paper green house bread light water field north music table glass chair storm".split()
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ascii_lower(text):
    return text.translate(_LOWER)


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))
