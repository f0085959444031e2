"""Names of clubs brought to a common key, and how alike two names are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters without a decomposition, letters with marks, and affixes that don't tell clubs apart.
PLAIN = {"ø": "o", "æ": "ae", "å": "a", "ð": "d", "ß": "ss", "ł": "l"}
MARKED, UNMARKED = "áàâäãéèêëíìîïóòôöõúùûüçñýÿšžčřěůćńśźżąęğş", "aaaaaeeeeiiiiooooouuuucnyyszcreucnszzaegs"
AFFIXES = ("fc", "cf", "sc", "ac", "afc", "sv", "kv", "uk", "fk", "sk")
#: Spellings of a club, each with the key that it stands for.
ALIASES = {
    "man city": "manchester city",
    "man utd": "manchester united",
    "man united": "manchester united",
    "bayern munchen": "bayern munich",
    "fc bayern munchen": "bayern munich",
    "atletico de madrid": "ath madrid",
    "club atletico de madrid": "ath madrid",
    "kobenhavn": "copenhagen",
    "fc kobenhavn": "fc copenhagen",
    "royale union saint gilloise": "st gilloise",
    "eintracht frankfurt": "ein frankfurt",
    "internazionale milano": "inter",
    "fc internazionale milano": "inter",
    "paris saint germain": "paris sg",
    "paris st germain": "paris sg",
    "paris sg fc": "paris sg",
    "bayer 04 leverkusen": "leverkusen",
    "1 koln": "koln",
    "queens park rangers": "qpr",
    "nottm forest": "nottingham forest",
    "nottingham forrest": "nottingham forest",
    "olympiacos": "olympiakos",
    "pae olympiakos sfp": "olympiakos",
}


def normal_name(name: Column) -> Column:
    """Lower case without marks, apostrophes, punctuation and club affixes; "&" is "and"."""
    text = F.lower(F.trim(name))
    for a, b in PLAIN.items():
        text = F.replace(text, F.lit(a), F.lit(b))
    text = F.translate(text, MARKED, UNMARKED)
    text = F.regexp_replace(F.replace(text, F.lit("&"), F.lit(" and ")), "['’�]", "")
    words = F.filter(F.split(F.regexp_replace(text, "[^a-z0-9]+", " "), " "), lambda w: (w != "") & ~w.isin(*AFFIXES))
    return F.array_join(words, " ")


def canonical_name(name: Column, aliases: dict[str, str] | None = None) -> Column:
    """The normal name, with known aliases replaced."""
    table = ALIASES if aliases is None else aliases
    key = normal_name(name)
    if not table:
        return key
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key], key)


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence: a row of the table is a number, and its zero bits are counted."""
    at: dict[str, int] = {}
    for k, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << k
    row = whole = (1 << len(a)) - 1
    for c in b:
        hit = row & at.get(c, 0)
        row = (row + hit | row - hit) & whole
    return len(a) - row.bit_count()


def token_set_score(a: str | None, b: str | None) -> float:
    """0 to 100: the best of three comparisons of what two names share and what each has besides, by insertions and deletions.

    Words are split at white space, case counts. A name whose words are all in the other one scores 100; without words, 0.
    """
    x, y = set((a or "").split()), set((b or "").split())
    if not x or not y:
        return 0.0
    both, only_a, only_b = x & y, " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and not (only_a and only_b):
        return 100.0
    shared = len(" ".join(sorted(both)))
    gap = 1 if shared else 0
    la, lb = shared + gap + len(only_a), shared + gap + len(only_b)
    edits = len(only_a) + len(only_b) - 2 * common(only_a, only_b)
    scores = [1 - edits / (la + lb)]
    if shared:
        scores += [1 - (gap + len(only_a)) / (shared + la), 1 - (gap + len(only_b)) / (shared + lb)]
    return 100 * max(scores)


def oxford_list(names: Column) -> Column:
    """a; a and b; a, b, and c."""
    n = F.size(names)
    return F.when(n <= 2, F.array_join(names, " and ")).otherwise(F.concat(F.array_join(F.slice(names, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(", and "), F.element_at(names, -1)))
