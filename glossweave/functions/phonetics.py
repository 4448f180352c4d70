"""ARPAbet keys: rhyme part, onset split, one-token neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import squeeze

# --- fixed values: the ARPAbet inventory -------------------------------------
CONSONANTS = (
    "B CH D DH DX EL EM EN F G HH JH K L M N NG NX P Q R S SH T TH V W WH Y Z ZH"
).split()
VOWELS = "AA AE AH AO AW AX AXR AY EH ER EY IH IX IY OW OY UH UW UX".split()
STRESSES = "0 1 2".split()
# --- end of fixed values -----------------------------------------------------

INVENTORY = CONSONANTS + [v + s for v in VOWELS for s in STRESSES]

_FROM_STRESSED = r"(?:^|\s)(\S*[12](?:\s\S*[^12\s])*)$"
_FROM_VOWEL = r"(?:^|\s)(\S*[0-9](?:\s\S*[^0-9\s])*)$"
_ONSET = rf"^((?:(?!(?:{'|'.join(VOWELS)})[012]?(?:\s|$))\S+(?:\s|$))*)(.*)$"


def rhyme_key(phonemes: Column) -> Column:
    """From the last stressed token on; else the last vowel; else the last two tokens."""
    text = squeeze(F.upper(phonemes))
    tokens = F.split(text, " ")
    tail = F.when(F.size(tokens) >= 2, F.slice(tokens, -2, 2)).otherwise(tokens)
    stressed = F.regexp_extract(text, _FROM_STRESSED, 1)
    voiced = F.regexp_extract(text, _FROM_VOWEL, 1)
    return (
        F.when(stressed != "", stressed)
        .when(voiced != "", voiced)
        .otherwise(F.array_join(tail, " "))
    )


def onset(phonemes: Column) -> Column:
    """Tokens before the first vowel ('' when the word starts with one)."""
    return F.trim(F.regexp_extract(squeeze(phonemes), _ONSET, 1))


def remainder(phonemes: Column) -> Column:
    return F.regexp_extract(squeeze(phonemes), _ONSET, 2)


def deletions(tokens: Column) -> Column:
    """Every key made by deleting one token, with the token that was removed."""
    spots = F.sequence(F.lit(1), F.size(tokens))

    def without(i: Column) -> Column:
        kept = F.concat(
            F.slice(tokens, F.lit(1), i - 1), F.slice(tokens, i + 1, F.size(tokens))
        )
        return F.struct(
            i.alias("spot"),
            F.array_join(kept, " ").alias("rest"),
            F.element_at(tokens, i).alias("token"),
        )

    return F.transform(spots, without)


def in_inventory(token: Column) -> Column:
    return token.isin(INVENTORY)
