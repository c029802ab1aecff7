"""Reading level of documents: article extraction, language, readability grades, bands learnt from labels."""

from __future__ import annotations

import math
import re
import statistics
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.session import cut

LANGUAGES = ("en", "de", "fr")
#: An article has at least so many words in sentences.
LEAST_WORDS = 60
#: Sentences count in stretches of lines without other lines between; one of fewer words stands alone, like a notice.
LEAST_STRETCH = 25
#: The bands are learnt from at most so many labelled documents.
LABELLED_DOCS = 20_000

# The first articles of the Universal Declaration of Human Rights, from which the letter profiles of the languages come; Spanish, Italian
# and Dutch stand for neighbours, whose texts are no case.
PROFILE_TEXTS = {
    "en": (
        "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a "
        "spirit of brotherhood. Everyone is entitled to all the rights and freedoms set forth in this Declaration, without distinction of any kind, such as "
        "race, colour, sex, language, religion, political or other opinion, national or social origin, property, birth or other status. Furthermore, no "
        "distinction shall be made on the basis of the political, jurisdictional or international status of the country or territory to which a person belongs, "
        "whether it be independent, trust, non-self-governing or under any other limitation of sovereignty. Everyone has the right to life, liberty and "
        "security of person. No one shall be held in slavery or servitude; slavery and the slave trade shall be prohibited in all their forms. No one shall be "
        "subjected to torture or to cruel, inhuman or degrading treatment or punishment. Everyone has the right to recognition everywhere as a person before "
        "the law. "
    ),
    "de": (
        "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geiste der "
        "Brüderlichkeit begegnen. Jeder hat Anspruch auf alle in dieser Erklärung verkündeten Rechte und Freiheiten, ohne irgendeinen Unterschied, etwa nach "
        "Rasse, Hautfarbe, Geschlecht, Sprache, Religion, politischer oder sonstiger Anschauung, nationaler oder sozialer Herkunft, Vermögen, Geburt oder "
        "sonstigem Stand. Des weiteren darf kein Unterschied gemacht werden auf Grund der politischen, rechtlichen oder internationalen Stellung des Landes "
        "oder Gebietes, dem eine Person angehört, gleichgültig ob dieses unabhängig ist, unter Treuhandschaft steht, keine Selbstregierung besitzt oder sonst "
        "in seiner Souveränität eingeschränkt ist. Jeder hat das Recht auf Leben, Freiheit und Sicherheit der Person. Niemand darf in Sklaverei oder "
        "Leibeigenschaft gehalten werden; Sklaverei und Sklavenhandel in allen ihren Formen sind verboten. Niemand darf der Folter oder grausamer, "
        "unmenschlicher oder erniedrigender Behandlung oder Strafe unterworfen werden. Jeder hat das Recht, überall als rechtsfähig anerkannt zu werden. "
    ),
    "fr": (
        "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les "
        "autres dans un esprit de fraternité. Chacun peut se prévaloir de tous les droits et de toutes les libertés proclamés dans la présente Déclaration, "
        "sans distinction aucune, notamment de race, de couleur, de sexe, de langue, de religion, d'opinion politique ou de toute autre opinion, d'origine "
        "nationale ou sociale, de fortune, de naissance ou de toute autre situation. De plus, il ne sera fait aucune distinction fondée sur le statut "
        "politique, juridique ou international du pays ou du territoire dont une personne est ressortissante, que ce pays ou territoire soit indépendant, sous "
        "tutelle, non autonome ou soumis à une limitation quelconque de souveraineté. Tout individu a droit à la vie, à la liberté et à la sûreté de sa "
        "personne. Nul ne sera tenu en esclavage ni en servitude; l'esclavage et la traite des esclaves sont interdits sous toutes leurs formes. Nul ne sera "
        "soumis à la torture, ni à des peines ou traitements cruels, inhumains ou dégradants. Chacun a le droit à la reconnaissance en tous lieux de sa "
        "personnalité juridique. "
    ),
    "es": (
        "Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente "
        "los unos con los otros. Toda persona tiene los derechos y libertades proclamados en esta Declaración, sin distinción alguna de raza, color, sexo, "
        "idioma, religión, opinión política o de cualquier otra índole, origen nacional o social, posición económica, nacimiento o cualquier otra condición. "
        "Todo individuo tiene derecho a la vida, a la libertad y a la seguridad de su persona. Nadie estará sometido a esclavitud ni a servidumbre; la "
        "esclavitud y la trata de esclavos están prohibidas en todas sus formas. Nadie será sometido a torturas ni a penas o tratos crueles, inhumanos o "
        "degradantes. "
    ),
    "it": (
        "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli "
        "altri in spirito di fratellanza. Ad ogni individuo spettano tutti i diritti e tutte le libertà enunciate nella presente Dichiarazione, senza "
        "distinzione alcuna, per ragioni di razza, di colore, di sesso, di lingua, di religione, di opinione politica o di altro genere, di origine nazionale o "
        "sociale, di ricchezza, di nascita o di altra condizione. Ogni individuo ha diritto alla vita, alla libertà ed alla sicurezza della propria persona. "
        "Nessun individuo potrà essere tenuto in stato di schiavitù o di servitù. Nessun individuo potrà essere sottoposto a tortura o a trattamento o a "
        "punizioni crudeli, inumani o degradanti. "
    ),
    "nl": (
        "Alle mensen worden vrij en gelijk in waardigheid en rechten geboren. Zij zijn begiftigd met verstand en geweten, en behoren zich jegens elkander in "
        "een geest van broederschap te gedragen. Een ieder heeft aanspraak op alle rechten en vrijheden, in deze Verklaring opgesomd, zonder enig onderscheid "
        "van welke aard ook, zoals ras, kleur, geslacht, taal, godsdienst, politieke of andere overtuiging, nationale of maatschappelijke afkomst, eigendom, "
        "geboorte of andere status. Een ieder heeft het recht op leven, vrijheid en onschendbaarheid van zijn persoon. Niemand zal in slavernij of horigheid "
        "gehouden worden. Niemand zal onderworpen worden aan folteringen, noch aan een wrede, onmenselijke of onterende behandeling of bestraffing. "
    ),
}
#: An article's mean log probability of a letter is at least so great in its own language.
LEAST_FIT = -6.4

URL = re.compile(r"https?://\S+")
BRACKETS = re.compile(r"\([^()]*\)")
DIGIT = re.compile(r"\d")
END = re.compile(r"[.!?…]+")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
ASCII_WORD = re.compile(r"[a-z]+(?:'[a-z]+)*")
LATIN = re.compile(r"[A-Za-z]")
#: Signs of code, tables, rows of links and chat.
ODD = re.compile(r"[{}<>=\[\]|\\;\t]|[☀-➿⬀-⯿\U0001f000-\U0001faff]")

# Fixed values of the hyphenation rules: letters that are one nucleus together, vowels, and consonants that stay together at the begin of a syllable.
JOINT = {
    "en": "eau|(?<=[tsc])i[ao]|ai|ay|au|ea|ee|ei|eu|ey|ie|oa|oe|oi|oo|ou|oy|ue|ui",
    "de": "aa|ai|au|ay|äu|ee|ei|eu|ey|ie|oo",
    "fr": "eau|œu|oeu|ai|aî|au|ay|ei|eu|eû|oi|oî|ou|où|oû|oy|ui|io|ie|ia",
}
VOWELS = {"en": "aeiouy", "de": "aeiouyäöü", "fr": "aeiouyàâäéèêëîïôöùûüœæ"}
ONSETS = {
    "en": "bl br ch cl cr dr fl fr gl gr kn ph pl pr qu sc sch scr sh sk sl sm sn sp spl spr squ st str sw th thr tr tw wh wr",
    "de": "bl br ch ck dr fl fr gl gn gr kl kn kr pf ph pl pr qu sch schl schm schn schr schw sp spr st str th tr zw",
    "fr": "bl br ch cl cr dr fl fr gl gn gr gu ph pl pr qu th tr vr",
}
#: Endings whose vowel is silent, in words of more than three letters.
SILENT = {
    "en": re.compile(r"(?<=[^aeiouyl])e$|(?<=[aeiouy]l)e$|(?<=[^aeiouysxzcgh])es$|(?<=[^aeiouytdl])ed$"),
    "de": None,
    "fr": re.compile(r"(?<=[^aeiouyàâäéèêëîïôöùûüœæ])(?:e|es|ent)$(?<!ment)"),
}
_NUCLEUS = {k: re.compile(f"{JOINT[k]}|[{VOWELS[k]}]") for k in LANGUAGES}
_ONSET = {k: frozenset(v.split()) for k, v in ONSETS.items()}


def hyphenate(word: str, lang: str) -> list[str]:
    """Syllables of a lower-case word by hyphenation-style rules; a word without vowels is one.

    Every nucleus (a vowel or vowels that sound together) makes a syllable, but for silent endings. Between two nuclei the break lies before the
    last consonant, or before the longest group of them that may begin a syllable; vowels that do not sound together are parted.
    """
    silent = SILENT[lang].search(word) if SILENT[lang] is not None and len(word) > 3 else None
    spans = [m.span() for m in _NUCLEUS[lang].finditer(word, 0, silent.start() if silent else len(word))]
    cuts = [0]
    for (_, end), (start, _) in zip(spans, spans[1:], strict=False):
        k = start - 1 if start > end else start
        for n in (4, 3, 2):
            if start - n >= end and word[start - n : start] in _ONSET[lang]:
                k = start - n
                break
        cuts.append(k)
    return [word[a:b] for a, b in zip(cuts, [*cuts[1:], len(word)], strict=True)]


def syllables(word: str, lang: str) -> int:
    """Number of syllables of a lower-case word; at least 1."""
    return len(hyphenate(word, lang))


def _bracket(m: re.Match) -> str:
    return " " if DIGIT.search(m.group()) else m.group()


def line_sentences(line: str) -> tuple[list[list[str]], bool]:
    """Ended sentences of a line (lists of lower-case words) and whether the rest after them looks like links. In time linear to the line's length."""
    if "(" in line:
        line = BRACKETS.sub(_bracket, line)
    if "://" in line:
        line = URL.sub(" ", line)
    line = line.lower()
    *parts, rest = END.split(line)
    word = ASCII_WORD if line.isascii() else WORD
    out = []
    for s in parts:
        words = word.findall(s)
        if len(words) < 2:
            continue
        letters = "".join(words)
        # mostly letters, mostly Latin ones (garbled accents may be of any script)
        if len(letters) > 0.6 * (len(s) - s.count(" ")) and (letters.isascii() or len(LATIN.findall(letters)) > 0.6 * len(letters)) and not ODD.search(s):
            out.append(words)
    return out, ODD.search(rest) is not None


def article_sentences(text: str) -> list[list[str]]:
    """Sentences (lists of words) of the connected prose of a page.

    Prose are ended sentences, mostly of letters, without signs of code, tables or chat. They count in stretches: lines that end in links or have
    no sentence (menus, titles, tables; not empty ones) part the page, and a stretch of fewer than 25 words (a notice, a footer) does not count.
    """
    out: list[list[str]] = []
    stretch: list[list[str]] = []
    for line in [*text.splitlines(), "."]:
        if not line or line.isspace():
            continue
        found, links = line_sentences(line)
        if found and not links:
            stretch += found
            continue
        if sum(map(len, stretch)) >= LEAST_STRETCH:
            out += stretch
        stretch = []
    return out


def _grams(word: str) -> list[str]:
    w = f" {word} "
    return [w[i : i + n] for n in (1, 2, 3) for i in range(n == 1, len(w) - n + (n > 1))]


class Words:
    """A growing table of known words: log probability by language profile, letters, and syllables in each language.

    The profiles are counts of one, two and three letters in the profile texts, smoothed.
    """

    SMOOTH, KINDS = 0.3, {1: 40, 2: 900, 3: 9000}

    def __init__(self) -> None:
        counts = {k: Counter(g for w in WORD.findall(t.lower()) for g in _grams(w)) for k, t in PROFILE_TEXTS.items()}
        total = {k: {n: sum(c for g, c in v.items() if len(g) == n) for n in self.KINDS} for k, v in counts.items()}
        log = lambda k, n, c: math.log((c + self.SMOOTH) / (total[k][n] + self.SMOOTH * self.KINDS[n]))
        self.table = {g: np.array([log(k, len(g), counts[k][g]) for k in counts]) for g in set().union(*counts.values())}
        self.floor = {n: np.array([log(k, n, 0) for k in counts]) for n in self.KINDS}
        self.names = list(counts)
        self.number: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.names) + 1 + len(LANGUAGES)))

    def find(self, words: list[str]) -> np.ndarray:
        """Rows of words: a log probability per profile, letters, syllables per language."""
        if len(self.number) > 500_000:
            self.number.clear()
        get = self.number.get
        ids = [get(w, -1) for w in words]
        if -1 in ids:
            for w in words:
                if w not in self.number:
                    self._add(w)
            ids = [self.number[w] for w in words]
        return self.rows[ids]

    def _add(self, word: str) -> None:
        n = self.number[word] = len(self.number)
        if n >= len(self.rows):
            self.rows = np.vstack([self.rows, np.zeros_like(self.rows)])
        fit = sum(self.table.get(g, self.floor[len(g)]) for g in _grams(word)) / 3
        self.rows[n] = [*fit, len(word), *(syllables(word, k) for k in LANGUAGES)]

    def language(self, found: np.ndarray) -> str | None:
        """The language whose profile fits best; null if it is a neighbour's, or fits badly."""
        m = len(self.names)
        score = found[:, :m].sum(axis=0) / max(1.0, found[:, m].sum())
        k = int(score.argmax())
        return self.names[k] if score[k] >= LEAST_FIT and self.names[k] in LANGUAGES else None


_WORDS: Words | None = None


def known_words() -> Words:
    """The process's table of words."""
    global _WORDS
    if _WORDS is None:
        _WORDS = Words()
    return _WORDS


def language(words: list[str]) -> str | None:
    """en, de or fr by letter profiles; null for other languages."""
    w = known_words()
    return w.language(w.find(words)) if words else None


def grades(sentences: list[list[str]], lang: str, found: np.ndarray | None = None) -> list[float]:
    """Seven classic estimates of the school grade, from lengths of sentences and words and from syllables."""
    w = known_words()
    found = w.find([x for s in sentences for x in s]) if found is None else found
    sizes, counts = found[:, len(w.names)], found[:, len(w.names) + 1 + LANGUAGES.index(lang)]
    n, m = len(found), len(sentences)
    letters, syl, one = sizes.sum(), counts.sum(), float((counts == 1).sum())
    hard, long6 = float((counts >= 3).sum()), float((sizes > 6).sum())
    wps, spw, cpw = n / m, syl / n, letters / n
    smog = 1.043 * (hard * 30 / m) ** 0.5 + 3.1291
    ari = 4.71 * cpw + 0.5 * wps - 21.43
    coleman = 5.88 * cpw - 29.6 * m / n - 15.8
    lix, rix = (wps + 100 * long6 / n - 10) / 4.0, 2.0 + 1.6 * long6 / m
    fog = 0.4 * (wps + 100 * hard / n)
    if lang == "en":
        first = 0.39 * wps + 11.8 * spw - 15.59
    elif lang == "de":
        first, fog = 0.1935 * 100 * hard / n + 0.1672 * wps + 0.1297 * 100 * long6 / n - 0.0327 * 100 * one / n - 0.875, (wps + 58.5 * spw - 80) / 6.0
    else:
        first = (1.015 * wps + 73.6 * spw - 107) / 6.0
    return [float(x) for x in (first, fog, smog, ari, coleman, lix, rix)]


FEATURES = "doc_id long, lang string, n_words long, n_sentences long, grade double, grades array<double>"


def reading_features(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, n_words, n_sentences, grade, grades) of every document with an article of at least 60 words in a known language.

    ``grade`` is the median of the classic formulas of the article's language, over the whole article. Null, empty and blank texts and
    pages without such an article (tables, code, chat, errors, other scripts and languages) give no row. docs: doc_id, text; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = known_words()
        for b in batches:
            rows = []
            for key, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                sentences = article_sentences(text)
                words = [w for s in sentences for w in s]
                if len(words) < LEAST_WORDS:
                    continue
                found = table.find(words)
                lang = table.language(found)
                if lang:
                    g = grades(sentences, lang, found)
                    rows.append((key, lang, len(words), len(sentences), statistics.median(g), g))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "lang", "n_words", "n_sentences", "grade", "grades"])

    return docs.where("text is not null and length(text) >= 100").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FEATURES)


#: Grades at which bands 2 and 3 begin where a language has too few labels to learn from.
DEFAULT_LIMITS = (5.5, 14.0)


def learn_limits(labelled: list[tuple[str, float, float]], least: int = 30) -> dict[str, tuple[float, float]]:
    """Two limits of the grade per language that err least on (lang, grade, band), bands in 1..3 or between two for disputed ones."""
    out = {}
    for lang in LANGUAGES:
        x = sorted((g, b) for k, g, b in labelled if k == lang)
        if len(x) < least:
            out[lang] = DEFAULT_LIMITS
            continue
        grade, band = np.array([g for g, _ in x]), np.array([b for _, b in x])
        limits = []
        for step in (1.5, 2.5):
            above = (band > step).astype(int)
            # errors if the limit lies before position i: those above left of it, those below right of it
            wrong = np.r_[0, np.cumsum(above)] + np.r_[np.cumsum((1 - above)[::-1])[::-1], 0]
            wrong[1:-1][grade[1:] == grade[:-1]] = len(x) + 1  # equal grades are not parted
            good = np.flatnonzero(wrong == wrong.min())
            i = int(good[len(good) // 2])
            limits.append(float(grade[0] - 1 if i == 0 else grade[-1] + 1 if i == len(grade) else (grade[i - 1] + grade[i]) / 2))
        out[lang] = (limits[0], max(limits))
    return out


def learn_scales(rows: list[tuple[str, list[float], float]]) -> dict[str, np.ndarray]:
    """Two limits for every estimate of a language, from (lang, estimates, band): what brings the estimates to one scale."""
    out = {}
    for lang in LANGUAGES:
        own = [(g, b) for k, g, b in rows if k == lang]
        n = len(own[0][0]) if own else 7
        out[lang] = np.array([learn_limits([(lang, g[i], b) for g, b in own])[lang] for i in range(n)])
    return out


def levels(lang: np.ndarray, estimates: np.ndarray, scales: dict[str, np.ndarray]) -> np.ndarray:
    """Median of the estimates of each article, each first brought to the scale on which its language's limits are 1.5 and 2.5."""
    out = np.zeros(len(lang))
    for k, s in scales.items():
        i = np.flatnonzero(lang == k)
        if len(i):
            out[i] = np.median(1.5 + (estimates[i] - s[:, 0]) / np.maximum(s[:, 1] - s[:, 0], 1e-9), axis=1)
    return out


def reading_levels(docs: DataFrame, labels: DataFrame, max_labelled: int = LABELLED_DOCS) -> DataFrame:
    """(doc_id, lang, n_words, grade, level, band) of every document with an article (see ``reading_features``); band 1 easy, 2 ordinary, 3 demanding.

    The estimates have different scales. Two limits for each, per language, are learnt from the median label (null bands do not count) of at
    most ``max_labelled`` labelled documents, chosen by hash; a language with fewer than 30 takes fixed limits. They bring the estimates to one
    scale; ``level`` is their median on it and alone decides the band, which begins at 1.5 and 2.5. ``grade`` is the median before that.
    Empty labels: fixed limits. Documents that are there twice come out twice.
    """
    features = cut(reading_features(docs))
    votes = labels.where("band between 1 and 3").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.expr("percentile(band, 0.5)").alias("band"))
    sample = features.join(votes, "doc_id").orderBy(F.xxhash64("doc_id")).limit(max_labelled).select("lang", "grades", "band").collect()
    scales = learn_scales([(r["lang"], r["grades"], float(r["band"])) for r in sample])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                estimates = b.column("grades").flatten().to_numpy().reshape(len(b), -1)
                level = levels(np.array(b.column("lang").to_pylist()), estimates, scales)
                band = (np.digitize(level, [1.5, 2.5]) + 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "lang", "n_words", "grade")), pa.array(level), pa.array(band)], names=["doc_id", "lang", "n_words", "grade", "level", "band"])

    return features.mapInArrow(run, "doc_id long, lang string, n_words long, grade double, level double, band int")
