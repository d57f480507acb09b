"""Code points as the tokenizers library sees them, found by asking it for each.

Its parts follow several versions of Unicode, none of which is Python's: classes and case a
newer one, normalization an older one. So these tables are kept here, and tests compare them
with the installed library.
"""

from __future__ import annotations

#: Steps to the next run's first code point and that run's class: S white space, L letters, N numbers, O others.
_RUNS = """
0O 9S 5O 12S 1O fN aO 7L 1aO 6L 1aO aS 1O 1aS 1O 9L 1O 7N 2O 1L 1O 3N 1L 1O 1N 3O 1L 17O 1L 1fO 1L 1caO 4L cO eL 5O 7L 1O 1L 1O 81L 5O 1L 2O 2L 4O 1L
1O 6L 1O 1L 3O 1L 1O 1L 14O 1L 53O 1L 8bO 8L a6O 1L 26O 2L 1O 6L 29O 47L 1bO 4L 4O 2dL 2bO 15N aO 4L 2O 1L 63O 1L 1O fL 2O 7L 2N aL 3O 2L 1O 10L 1O 1L
1eO 1dL 59O bL 1O eN aL 21O 9L 2O 4L 1O 5L 16O 4L 1O 9L 1O 3L 1O 17L 19O 7L bO 5L 18O 1L 6O 11L 2aO 3aL 36O 3L 1O 12L 1O 7L aO 4N aO 1L 10O 4L 8O 2L
2O 2L 16O 1L 7O 1L 1O 3L 4O 3L 1O 10L 1O dL 2O 1L 3O 4N aL 2O 2N 6O 2L 1O 8L 6O 4L 2O 2L 16O 1L 7O 1L 2O 1L 2O 1L 2O 1fL 4O 1L 1O 7N aO 2L 3O 10L 9O
1L 3O 1L 16O 1L 7O 1L 2O 1L 5O 3L 1O 12L 1O fL 2O 4N aO 9L 1O bL 8O 2L 2O 2L 16O 1L 7O 1L 2O 1L 5O 3L 1O 1eL 2O 1L 3O 4N aO 1L 1N 6O bL 1O 1L 6O 3L 3O
1L 4O 3L 2O 1L 1O 1L 2O 3L 2O 3L 3O 3L cO 16L 1O 15N dO 12L 8O 1L 3O 1L 17O 1L 10O 3L 1O 1aL 3O 2L 1O 2L 2O 4N aO 8N 7O 1L 1O 4L 8O 1L 3O 1L 17O 1L aO
1L 5O 3L 1O 1fL 2O 1L 2O 4N aO 1L 2O 11L 9O 1L 3O 1L 29O 2L 1O 10L 1O 5L 3O 1N 7L 3O 4N 13O 1L 6O 5L 12O 3L 18O 1L 9O 1L 1O 2L 7O 1fN aO 11L 30O 1L 2O
cL 7O 9N aO 27L 2O 1L 1O 1L 5O 1L 18O 1L 1O 1L aO 1L 2O 9L 1O 2L 5O 1L 1O 9N aO 2L 4O 20L 1O 1fN 14O cL 8O 1L 24O 1bL 5O 73L 2bO 14L 1N aO 6L 6O 4L 4O
3L 1O 3L 2O 7L 3O 4L dO cL 1O 1N aO 6L 26O 1L 1O 5L 1O 2L 2bO 1L 14dO 1L 4O 2L 7O 1L 1O 1L 4O 2L 29O 1L 4O 2L 21O 1L 4O 2L 7O 1L 1O 1L 4O 2L fO 1L 39O
1L 4O 2L 43O eN 14O 3L 10O 10L 56O 2L 6O 3L 26cO 2L 11S 1L 1aO 5L 4bO 3N 3L 8O 7L 12O dL 13O eL 12O eL dO 1L 3O fL 34O 23L 1O 4L 1O 3N aO 6N aO 16N aO
6L 59O 7L 5O 2L 22O 1L 1O 5L 46O aL 1fO 27N aL 1eO 2L 5O bL 2cO 4L 1aO 6N bO 25L 17O 9L 35O 2bN aO 6N aO dL 1O 5dL 2fO 11L 8O 3N aO 29L 1eO dL 2N aL
2cO 1aL 24O 1cN aO 3L 3N aL 24O 2L bO 5L 2bO 2L 3O 29L 4O 1L 6O 1L 2O 3L 1O 5L c0O 40L 116O 2L 6O 2L 26O 2L 6O 2L 8O 1L 1O 1L 1O 1L 1O 1L 1fO 2L 35O
1L 7O 1L 1O 3L 3O 1L 7O 3L 4O 2L 6O 4L dO 5L 3O 1L 7O 3S bO 1dS 2O 5S 1O 2fS 1O 10N 1L 1O 2N 6O 5L 1N aO 6L dO 65L 1O 4L 1O 2L aO 1L 1O 3L 5O 6L 1O 1L
1O 1L 1O 1L 4O 1L bO 2L 4O 5L 5O 4L 1O 1N 33L 2N 5O 2d6N 3cO 4eN 16O 276N 1eO 46cL e5O 6L 4O 3L 2O 9N 1O 2L 26O 1L 1O 5L 1O 2L 38O 7L 1O 10L 17O 9L 7O
1L 7O 1L 7O 1L 7O 1L 7O 1L 7O 1L 7O 1L 7O 50L 1O 1d0S 1O 4L 2N 1O 19N 9O 7L 5O 2N 3L 2O 4L 56O 6L 3O 1L 5aO 1L 4O 5L 2bO 1L 5eO 3N 4O aL 20O 30L 10O
20N aO 1eN 8O 1N fO 20N aO 27N fO 140L 19c0O 40L 568dO 43L 2eO 2L 10dO 3L 10N aL 2O 14L 2fO 10L 1fO 2L 46N aO 27L 9O 2L 67O 2L 43O 2L 2O 1L 1O 1L 8O
15L 10O 1L 3O 1L 4O 1L 17O dN 6O aL 34O eL 32O 1cN aO 18L 6O 3L 1O 1L 2O 1N aL 1cO aL 17O 19L 1dO 7L 2fO 1cL 1N aO 6L 5O 1L aN aL 5O 1L 29O 17L 3O 1L
8O 4N aO 6L 17O 3L 1O 3L 32O 1L 1O 3L 2O 2L 5O 2L 1O 1L 1O 18L 3O 2L bO 7L 3O cL 6O 2L 6O 2L 6O 9L 7O 1L 7O 1L 2bO 1L eO 6L 73O dN aO 6L 2ba4O cL 17O
4L 31O 2104L 16eO 2L 6aO 26L 7O cL 5O 5L 1O 1L aO 1L dO 1L 5O 1L 1O 1L 2O 1L 2O 1L 6cO 21L 16bO 12L 40O 2L 36O 28L cO 74L 5O 1L 87O 13N aO 7L 1aO 6L
1aO bL 59O 3L 6O 2L 6O 2L 6O 2L 3O 23L cO 1L 1aO 1L 13O 1L 2O 1L fO 2L eO 22L 7bO cN 2dO cN 39O 11N 2O f4L 1dO 3L 31O 10N 1bO 4L 20N 4O 9L 14N 1L 8N
1O 5L 26O aL 1eO 2L 24O 4L 8O 1N 5O 2aL 9eO 2N aO 6L 24O 4L 24O 4L 28O 8L 34O cL bO 1L fO 1L 7O 1L 2O 1L bO 1L fO 1L 7O 1L 2O 3L 34O cL 137O 9L 16O aL
8O 18L 6O 1L 2aO 1L 9O 45L 6O 2L 1O 1L 2cO 1L 2O 3L 1O 2L 17O 2N 8L 17O 2N 7L 1fO 8N 9O 30L 13O 1L 2O 5N 5L 16N 6O 4L 1aO 46L 38O 4N 2L 2N 10O 2N 2eL
1O fL 4O 1L 3O 1L 1dO aN 9O 17L 1dN 2O 1L 1dN 3O 20L 8O 1L 1cO 6N 5O 10L 36O aL 16O 2N 8L 13O 5N 8L 12O 17N 7O 50L 49O 37L 33O dL 33O 7N 6L 24O cN aO
6N aL 1cO 9L 17O daN 1fO 1L 2aO 6L 2O 10L 3O 3bL 1dN aL 1O 8L 16O bN 4O 1bL 12O 2eL 15N 7O 14L 17O cL 35O 1aN 1eO 1L 2O 2L 1O dL 2dO 20L 19O 7N aO 9L
24O fN aO 4L 1O 2L 1O 8L 23O 3L 1O cL 30O eL 4O bN aL 1O 1L 1O 4N 14O bL 12O 1L 19O 13L 2O 3fL 7O 1L 1O 1L 4O 1L fO 1L aO 7L 2fO 11N aO bL 8O 2L 2O 2L
16O 1L 7O 1L 2O 1L 5O 3L 1O 12L 1O cL 5O 1eL aO 1L 1O 2L 1O 1L 26O 1L 1O 19L 1O 1L 1O 2cL 35O 12L 4O 5N aO 5L 3O 1eL 30O 14L 2O 1L 1O 8N aO a6L 2fO
29L 4O 24L 30O 14L 1O bN aO 26L 2bO dL 1O 7N aO 6N 14O 1cL 1bO 15N cO 4L 7O b9L 2cO 74L 40N 13O cL 8O 2L 1O 2L 8O 1L 2O 1L 18O fL 1O 1L 1O eN aO 46L
8O 2L 27O 10L 1O 1L 1O 1cL 1O aL 28O 7L 1O 15L 1O bL 2eO 13L 1O 12L 49O c7L 21O fN aO 6L 9O 1L 25O 11L 1O fN 1dO 5L 1eO 70L 7O 1L 2O 1L 26O 15L 1O 9N
aO 6L 6O 1L 2O 1L 20O eL 1O 7N aO 136L 13O fL 1O 1L dO 1L 22O 1cN aO 56L 1O fN 15O 2bL 39aO 66N 6fO 11L c4O a4cL 61O fL 430O 11L 6O 19L f9bO 5L 247O
1ab9L 1eO 12N aO 6c6L 239O 7L 1fO 1N aO 6L 4fO 1N aO 6L 1eO 12L 30O 10L 4O cN aO 1N 7O 1L 15O 5L 13O 1b0L 2dO 3N aO c6L 40N 17O 69L 4bO 5L 1O 42L dO
40L 2O 1L 1O 1cL 17f8O 8L 4d6O 29L aO 22e7L 4O 1L 7O 1L 2O 1L 123O fL 1O 1dL 3O 2L 1O eL 4O 8L 18cO 904L 6bO 5L dO 3L 9O 7L aO 1056N aO 5c6N 14O cN
14O 6cN 19O 87L 55O 1L 47O 1L 2O 2L 1O 2L 2O 2L 4O 1L cO 1L 1O 1L 7O 1L 41O 1L 4O 2L 8O 1L 7O 1L 1cO 1L 4O 1L 5O 1L 1O 3L 7O 1L 154O 2L 19O 1L 19O 1L
1fO 1L 19O 1L 1fO 1L 19O 1L 1fO 1L 19O 1L 1fO 1L 19O 1L 8O 2N 32O 700L 1fO 6L 6O 105L 3eO 92L 2dO aL 7O 2N aO 4L 1O 141L 1eO 12L 2cO 4N aO 1d6L 1cO 4N
aO d6L 1eO 2L 1N aO 1e5L 7O 1L 4O 1L 2O 1L fO 1L c5O 2N 9O 30L 44O 7L 1O 4N aO 317N 3bO 1N 3O 1N 4O 4cN 2dO 1N fO c2L 4O 1L 1bO 1L 2O 1L 1O 2L 1O 1L
aO 1L 4O 1L 1O 1L 1O 6L 1O 4L 1O 1L 1O 1L 1O 1L 3O 1L 2O 1L 1O 2L 1O 1L 1O 1L 1O 1L 1O 1L 1O 1L 2O 1L 1O 2L 4O 1L 7O 1L 4O 1L 4O 1L 1O 1L aO 1L 11O 5L
3O 1L 5O 1L 11O 244N dO ae3N aO 406L a6e0O 20L 103aO 6L deO 2L 1682O eL 1d31O fL 26eO 9a2L 21eO 5e2L 134bO 5L 1060O
"""

#: Marks that its normalization leaves where they are, and joins with nothing.
_BARRIERS = """
7fd 898-89f 8ca-8d3 9fe c3c d3b-d3c eba 1715 1abf-1ace 1df6-1dfa a82c 10d24-10d27 10eab-10eac 10efd-10eff 10f46-10f50 10f82-10f85 11070 1133b 1145e
11839-1183a 11930 1193d-1193e 11943 119e0 11a34 11a47 11a99 11d42 11d44-11d45 11d97 11f41-11f42 16ff0-16ff1 1e08f 1e130-1e136 1e2ae 1e2ec-1e2ef
1e4ec-1e4ef
"""

#: Letters that it lower-cases and Python doesn't.
_LOWER = """
1c89>1c8a a7cb>264 a7cc>a7cd a7ce>a7cf a7d2>a7d3 a7d4>a7d5 a7da>a7db a7dc>19b 10d50>10d70 10d51>10d71 10d52>10d72 10d53>10d73 10d54>10d74 10d55>10d75
10d56>10d76 10d57>10d77 10d58>10d78 10d59>10d79 10d5a>10d7a 10d5b>10d7b 10d5c>10d7c 10d5d>10d7d 10d5e>10d7e 10d5f>10d7f 10d60>10d80 10d61>10d81
10d62>10d82 10d63>10d83 10d64>10d84 10d65>10d85 16ea0>16ebb 16ea1>16ebc 16ea2>16ebd 16ea3>16ebe 16ea4>16ebf 16ea5>16ec0 16ea6>16ec1 16ea7>16ec2
16ea8>16ec3 16ea9>16ec4 16eaa>16ec5 16eab>16ec6 16eac>16ec7 16ead>16ec8 16eae>16ec9 16eaf>16eca 16eb0>16ecb 16eb1>16ecc 16eb2>16ecd 16eb3>16ece
16eb4>16ecf 16eb5>16ed0 16eb6>16ed1 16eb7>16ed2 16eb8>16ed3
"""


def classes() -> list[tuple[int, str]]:
    """(first code point, class) of each run, ascending."""
    at, out = 0, []
    for x in _RUNS.split():
        at += int(x[:-1], 16)
        out.append((at, x[-1]))
    return out


def barriers() -> str:
    spans = [[int(y, 16) for y in x.split("-")] for x in _BARRIERS.split()]
    return "".join(chr(c) for s in spans for c in range(s[0], s[-1] + 1))


def lower() -> dict[int, int]:
    return {int(a, 16): int(b, 16) for a, b in (x.split(">") for x in _LOWER.split())}
