"""The Russian Snowball stemmer as a column expression.

The word is split after its first vowel; suffixes only go from the part behind it. The steps are those of the published
algorithm: perfective gerund, or else reflexive, then adjectival, verb or noun; a final и; derivational suffixes in the
second region; superlatives, double н and the soft sign. Words without Russian vowels stay as they are.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

VOWELS = "аеиоуыэюя"
#: The suffix classes of the algorithm. Those of a first group need а or я before them, inside the region.
GERUND = ("вшись вши в", "ившись ывшись ивши ывши ив ыв")
REFLEXIVE = ("", "ся сь")
ADJECTIVE = ("", "ими ыми его ого ему ому ее ие ые ое ей ий ый ой ем им ым ом их ых ую юю ая яя ою ею")
PARTICIPLE = ("ем нн вш ющ щ", "ивш ывш ующ")
VERB = ("ешь нно ете йте ла на ли ем ло но ет ют ны ть й л н", "ейте уйте ила ыла ена ите или ыли ило ыло ено ует уют ены ить ыть ишь ей уй ил ыл им ым ен ят ит ыт ую ю")
NOUN = ("", "иями иях ием ией иям ами ями еи ии ев ов ие ье ей ой ий ям ем ам ом ах ях ию ью ия ья а е и й о у ы ь ю я")
DERIVATIONAL = "ость|ост"
SUPERLATIVE = "ейше|ейш"


def _suffix(groups: tuple[str, str], before: str = "") -> str:
    first, second = ("|".join(g.split()) for g in groups)
    parts = [f"(?<=[ая])(?:{first})"] if first else []
    parts += [f"(?:{second})"] if second else []
    return f"{before}(?:{'|'.join(parts)})$"


_PARTICIPLE = f"(?:(?<=[ая])(?:{'|'.join(PARTICIPLE[0].split())})|(?:{'|'.join(PARTICIPLE[1].split())}))?"
_ADJECTIVAL = _suffix(ADJECTIVE, _PARTICIPLE)
_SPLIT = f"^([^{VOWELS}]*[{VOWELS}])(.*)$"


def stem(word: Column) -> Column:
    """The stem of a lower-case word (null stays null)."""
    word = F.translate(word, "ё", "е")
    start, rest = F.regexp_extract(word, _SPLIT, 1), F.regexp_extract(word, _SPLIT, 2)
    bare = F.regexp_replace(rest, _suffix(REFLEXIVE), "")
    drop = lambda x, pattern: F.regexp_replace(x, pattern, "")
    ending = F.when(bare.rlike(_suffix(ADJECTIVE)), drop(bare, _ADJECTIVAL)).when(bare.rlike(_suffix(VERB)), drop(bare, _suffix(VERB))).otherwise(drop(bare, _suffix(NOUN)))
    first = F.when(rest.rlike(_suffix(GERUND)), drop(rest, _suffix(GERUND))).otherwise(ending)
    second = drop(first, "и$")
    # The second region starts after the second vowel and consonant pair of the whole word.
    open_word = F.concat(start, second)
    region = rf"^([^{VOWELS}]*[{VOWELS}]+[^{VOWELS}][^{VOWELS}]*[{VOWELS}]+[^{VOWELS}].*?)(?:{DERIVATIONAL})$"
    third = F.regexp_replace(open_word, region, "$1")
    doubled = lambda x: F.regexp_replace(x, "нн$", "н")
    superlative = f"(?:{SUPERLATIVE})$"
    last = F.when(third.rlike("нн$"), doubled(third)).when(third.rlike(superlative), doubled(drop(third, superlative))).otherwise(drop(third, "ь$"))
    return F.when(word.rlike(f"[{VOWELS}]"), last).otherwise(word)


def stem_text(tokens: Column) -> Column:
    """Stems of an array of words, joined by one space. Words are only looked at where the text has Russian vowels."""
    text = lambda x: F.array_join(x, " ")
    # A lambda over a one-element array stands for a local name, so that the tokens are made once.
    return F.get(F.transform(F.array(tokens), lambda x: F.when(text(x).rlike(f"[ё{VOWELS}]"), text(F.transform(x, stem))).otherwise(text(x))), 0)


def stem_word(word: str) -> str:
    """The same for one query word."""
    word = word.replace("ё", "е")
    m = re.match(_SPLIT, word)
    if not m:
        return word
    start, rest = m.groups()
    if re.search(_suffix(GERUND), rest):
        rest = re.sub(_suffix(GERUND), "", rest)
    else:
        rest = re.sub(_suffix(REFLEXIVE), "", rest)
        if re.search(_suffix(ADJECTIVE), rest):
            rest = re.sub(_ADJECTIVAL, "", rest, count=1)
        else:
            rest = re.sub(_suffix(VERB) if re.search(_suffix(VERB), rest) else _suffix(NOUN), "", rest, count=1)
    out = start + re.sub("и$", "", rest)
    region = rf"^([^{VOWELS}]*[{VOWELS}]+[^{VOWELS}][^{VOWELS}]*[{VOWELS}]+[^{VOWELS}].*?)(?:{DERIVATIONAL})$"
    out = re.sub(region, r"\1", out)
    superlative = f"(?:{SUPERLATIVE})$"
    if out.endswith("нн"):
        return out[:-1]
    if re.search(superlative, out):
        return re.sub("нн$", "н", re.sub(superlative, "", out))
    return re.sub("ь$", "", out)
