"""Stems of English, German and French words by the published suffix-stripping algorithms, in Arrow batches.

A stemmer is a small machine over the regions of a word: R1 begins after the first consonant that follows a
vowel, R2 likewise inside R1, and RV (French) after the first vowel. Each step looks for the longest of its
endings and removes or replaces it where the region allows."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .batches import small_batches

# Endings, exceptions and letters below are those of the published algorithms.


def _after(word: str, vowels: str, start: int = 0) -> int:
    """Where a region begins: behind the first consonant after a vowel, from `start` on."""
    m = re.compile(f"[{vowels}][^{vowels}]").search(word, start)
    return m.end() if m else len(word)


def _ending(word: str, endings: Iterable[str], region: int = 0) -> str:
    """The longest of the endings that the word has behind the region's beginning, or nothing."""
    return max((e for e in endings if word.endswith(e) and len(word) - len(e) >= region), key=len, default="")


# English

_EN = "aeiouy"
_EN_WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_EN_KEPT = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_EN_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al",
    "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
_EN_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
_EN_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
_EN_SHORT = re.compile(f"(?:^[{_EN}][^{_EN}]|[^{_EN}][{_EN}][^{_EN}wxY])$")


def english(word: str) -> str:
    if word in _EN_WHOLE:
        return _EN_WHOLE[word]
    if len(word) <= 2:
        return word
    w = re.sub(f"(?:^|(?<=[{_EN}]))y", "Y", word.lstrip("'"))
    lead = re.match("gener|commun|arsen", w)
    r1 = lead.end() if lead else _after(w, _EN)
    r2 = _after(w, _EN, r1)
    w = w[: len(w) - len(_ending(w, ("'", "'s", "'s'")))]
    match _ending(w, ("sses", "ied", "ies", "s", "us", "ss")):
        case "sses":
            w = w[:-2]
        case "ied" | "ies":
            w = w[:-2] if len(w) > 4 else w[:-1]
        case "s" if re.search(f"[{_EN}]", w[:-2]):
            w = w[:-1]
    if w in _EN_KEPT:
        return w
    e = _ending(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if e in ("eed", "eedly"):
        w = w[: len(w) - len(e)] + "ee" if len(w) - len(e) >= r1 else w
    elif e and re.search(f"[{_EN}]", w[: len(w) - len(e)]):
        w = w[: len(w) - len(e)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif re.search(r"(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
            w = w[:-1]
        elif r1 >= len(w) and _EN_SHORT.search(w):
            w += "e"
    w = re.sub(f"(?<=.)(?<=[^{_EN}])[yY]$", "i", w) if len(w) > 2 else w
    e = _ending(w, _EN_2)
    if e and len(w) - len(e) >= r1 and (e != "ogi" or w[-4] == "l") and (e != "li" or w[-3] in "cdeghkmnrt"):
        w = w[: len(w) - len(e)] + _EN_2[e]
    e = _ending(w, _EN_3)
    if e and len(w) - len(e) >= (r2 if e == "ative" else r1):
        w = w[: len(w) - len(e)] + _EN_3[e]
    e = _ending(w, _EN_4)
    if e and len(w) - len(e) >= r2 and (e != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: len(w) - len(e)]
    if w.endswith("e") and (len(w) > r2 or (len(w) > r1 and not _EN_SHORT.search(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) > r2:
        w = w[:-1]
    return w.replace("Y", "y")


# German

_DE = "aeiouyäöü"


def german(word: str) -> str:
    w = re.sub(f"(?<=[{_DE}])([uy])(?=[{_DE}])", lambda m: m[1].upper(), word.replace("ß", "ss"))
    first = _after(w, _DE)
    r1, r2 = max(3, first), _after(w, _DE, first)
    e = _ending(w, ("em", "ern", "er", "e", "en", "es", "s"))
    if e and len(w) - len(e) >= r1 and (e != "s" or w[-2:-1] in tuple("bdfghklmnrt")):
        w = w[: len(w) - len(e)]
        if e in ("e", "en", "es") and w.endswith("niss"):
            w = w[:-1]
    e = _ending(w, ("en", "er", "est", "st"))
    if e and len(w) - len(e) >= r1 and (e != "st" or (len(w) >= 6 and w[-3] in "bdfghklmnt")):
        w = w[: len(w) - len(e)]
    e = _ending(w, ("end", "ung", "ig", "ik", "isch", "lich", "heit", "keit"))
    if e and len(w) - len(e) >= r2:
        stem = w[: len(w) - len(e)]
        if e in ("end", "ung"):
            w = stem
            if w.endswith("ig") and len(w) - 2 >= r2 and not w.endswith("eig"):
                w = w[:-2]
        elif e in ("ig", "ik", "isch"):
            w = w if stem.endswith("e") else stem
        elif e in ("lich", "heit"):
            w = stem[:-2] if stem.endswith(("er", "en")) and len(stem) - 2 >= r1 else stem
        else:
            inner = _ending(stem, ("lich", "ig"), r2)
            w = stem[: len(stem) - len(inner)]
    return w.lower().translate(str.maketrans("äöü", "aou"))


# French

_FR = "aeiouyâàëéêèïîôûù"
_FR_1 = (
    "ance iqUe isme able iste eux ances iqUes ismes ables istes atrice ateur ation atrices ateurs ations logie logies usion ution usions utions ence ences ement ements ité ités if ive ifs ives "
    "eaux aux euse euses issement issements amment emment ment ments"
).split()
_FR_I = (
    "îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante issantes issants isse issent isses issez issiez issions issons it"
).split()
_FR_PLAIN = "é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez".split()
_FR_E = "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions".split()


def french(word: str) -> str:
    w = re.sub(f"(?<=[{_FR}])([ui])(?=[{_FR}])", lambda m: m[1].upper(), word)
    w = re.sub(f"(?<=[{_FR}])y|y(?=[{_FR}])", "Y", w).replace("qu", "qU")
    r1 = _after(w, _FR)
    r2 = _after(w, _FR, r1)
    if re.match(f"[{_FR}]{{2}}|par|col|tap", w):
        rv = 3
    else:
        later = re.compile(f"[{_FR}]").search(w, 1)
        rv = later.end() if later else len(w)
    begun, verbal = w, False
    w, verbal = _french_nouns(w, r1, r2, rv)
    changed = w != begun
    if not changed or verbal:
        before = w
        e = _ending(w, _FR_I, rv)
        if e and len(w) - len(e) - 1 >= rv and w[-len(e) - 1] not in _FR:
            w = w[: len(w) - len(e)]
        if w == before:
            e = _ending(w, ("ions", *_FR_PLAIN, *_FR_E), rv)
            if e == "ions":
                w = w[:-4] if len(w) - 4 >= r2 else w
            elif e:
                w = w[: len(w) - len(e)]
                if e in _FR_E and w.endswith("e") and len(w) - 1 >= rv:
                    w = w[:-1]
        changed = changed or w != before
    if changed:
        w = w[:-1] + {"Y": "i", "ç": "c"}.get(w[-1:], w[-1:])
    else:
        if re.search("[^aiouès]s$", w):
            w = w[:-1]
        e = _ending(w, ("ion", "ier", "ière", "Ier", "Ière", "e"), rv)
        if e == "ion":
            w = w[:-3] if len(w) - 3 >= r2 and w[-4:-3] in ("s", "t") and len(w) - 4 >= rv else w
        elif e:
            w = w[: len(w) - len(e)] + ("" if e == "e" else "i")
    if w.endswith(("enn", "onn", "ett", "ell", "eill")):
        w = w[:-1]
    w = re.sub(f"[éè]([^{_FR}]+)$", r"e\1", w)
    return w.lower()


def _french_nouns(w: str, r1: int, r2: int, rv: int) -> tuple[str, bool]:
    """Standard endings: the word without one, and whether verbs' endings are to be tried too."""
    e = _ending(w, _FR_1)
    stem, at = w[: len(w) - len(e)], len(w) - len(e)

    def without(word: str, ending: str, otherwise: str | None = None) -> str:
        """word without an ending inside R2; outside it the ending may be replaced."""
        if not word.endswith(ending):
            return word
        cut = word[: len(word) - len(ending)]
        return cut if len(cut) >= r2 else word if otherwise is None else cut + otherwise

    if not e:
        return w, True
    if e in ("ement", "ements"):
        if at < rv:
            return w, True
        if stem.endswith("iv"):
            cut = without(stem, "iv")
            return (without(cut, "at") if cut != stem else cut), False
        if stem.endswith("eus"):
            return (stem[:-3] if len(stem) - 3 >= r2 else stem[:-1] + "x" if len(stem) - 3 >= r1 else stem), False
        if stem.endswith(("abl", "iqU")):
            return without(stem, stem[-3:]), False
        if stem.endswith(("ièr", "Ièr")) and len(stem) - 3 >= rv:
            return stem[:-3] + "i", False
        return stem, False
    if e in ("amment", "emment"):
        return (stem + {"a": "ant", "e": "ent"}[e[0]], True) if at >= rv else (w, True)
    if e in ("ment", "ments"):
        return (stem, True) if stem and stem[-1] in _FR and at - 1 >= rv else (w, True)
    if e in ("issement", "issements"):
        return (stem, False) if at >= r1 and stem and stem[-1] not in _FR else (w, True)
    if e == "eaux":
        return stem + "eau", False
    if e == "aux":
        return (stem + "al", False) if at >= r1 else (w, True)
    if e in ("euse", "euses"):
        return (stem, False) if at >= r2 else (stem + "eux", False) if at >= r1 else (w, True)
    if at < r2:
        return w, True
    if e.startswith(("atrice", "ateur", "ation")):
        return without(stem, "ic", "iqU"), False
    if e.startswith("logie"):
        return stem + "log", False
    if e.startswith(("usion", "ution")):
        return stem + "u", False
    if e.startswith("ence"):
        return stem + "ent", False
    if e.startswith("ité"):
        return without(stem, "abil", "abl") if stem.endswith("abil") else without(stem, "ic", "iqU") if stem.endswith("ic") else without(stem, "iv"), False
    if e in ("if", "ive", "ifs", "ives"):
        cut = without(stem, "at")
        return (without(cut, "ic", "iqU") if cut != stem else cut), False
    return stem, False


STEMMERS: dict[str, Callable[[str], str]] = {"simple": lambda w: w, "english": english, "german": german, "french": french}
#: Languages as short codes write them.
CODES = {"en": "english", "de": "german", "fr": "french"}


def stemmed(words: Column, language: Column) -> Column:
    """An array of lower-case words as stems; the language may be a name or a short code, any other leaves words as they are. A null array stays null."""
    small_batches()

    @F.arrow_udf("array<string>")
    def stems(column: pa.Array, names: pa.Array) -> pa.Array:
        flat = column.flatten()
        rows = np.repeat(np.arange(len(column)), np.diff(_ends(column)))
        langs = names.to_pylist()
        out: list[str | None] = flat.to_pylist()
        known: dict[tuple[str, str], str] = {}
        for i, (row, word) in enumerate(zip(rows.tolist(), out, strict=True)):
            name = CODES.get(langs[row], langs[row])
            if word is not None and name in STEMMERS:
                if (name, word) not in known:
                    known[name, word] = STEMMERS[name](word)
                out[i] = known[name, word]
        return pa.ListArray.from_arrays(pa.array(_ends(column), pa.int32()), pa.array(out, pa.string()), mask=column.is_null())

    return stems(words, language)


def _ends(column: pa.Array) -> np.ndarray:
    sizes = column.value_lengths().fill_null(0)
    return np.concatenate(([0], np.cumsum(np.asarray(sizes)))).astype(np.int64)
