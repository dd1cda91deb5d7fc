"""Problem 4: defective question-answer pairs and the type of each defect.

Tests in this order, the first that holds names the defect:
  empty           nothing is left of the answer without citations, placeholders and lead-ins
  copied          the longest common subsequence covers the question, and next to none of the answer's
                  shingles lies outside the question
  refusal         a sentence aligns with a refusal template (see REFUSALS), the answer states no figure that
                  the question lacks, and the question can be answered
  truncated       it breaks off: an open bracket, a hyphen, a comma, an ellipsis, a cut word, or last words
                  that the other answers never end with
  wrong_language  a sentence is in another language than the question: by its script, by the function words
                  it holds, or because its character trigrams are unlike the texts of the question's
                  language, which notices languages that no list has. The trigram models are fitted on
                  labelled texts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W_]+")
_CITE = re.compile(r"\s*[\[［【]\s*\d+(?:\s*[,;\-–]\s*\d+)*\s*[\]］】]")
_LEAD = re.compile(r"^\W*(?:(?:the|your|die|la|el|le)\s+)?(?:answer|question|response|antwort|réponse|respuesta|frage|you asked|asked)(?:\s+is)?\s*:\s*", re.I)
_NOTHING = {"", "null", "none", "na", "nan", "nil", "tbd", "undefined", "empty", "answer", "n a", "no answer"}

_SCRIPTS = (
    ("kana", re.compile("[぀-ヿ]")), ("han", re.compile("[一-鿿]")), ("hangul", re.compile("[가-힯]")), ("cyrillic", re.compile("[Ѐ-ӿ]")),
    ("greek", re.compile("[Ͱ-Ͽ]")), ("arabic", re.compile("[؀-ۿ]")), ("hebrew", re.compile("[֐-׿]")), ("devanagari", re.compile("[ऀ-ॿ]")), ("thai", re.compile("[฀-๿]")),
)

#: Ideas of which refusals are made, each with words for it (their beginnings where they end in "-").
IDEAS = {
    "not": "not no t cannot unable never nothing insufficient impossible refuse- decline- without lack- nicht nichts kein- ne n pas aucun- rien non impossible- nada ningun- ningún não nenhum- niet geen nulla nessun-",
    "tell": "answer- say- tell- determine- speculat- comment- conclu- respond- know- help- share- beantwort- antwort- sagen répond- dire determinar responder decir- diz- antwoord- zeggen risponder- conclure bestimm-",
    "access": "access- accès acceso zugang zugriff acesso toegang accesso information- evidence- informationen angabe- información",
    "hold": "contain- cover- say- state- mention- disclose- suffice- suffisent reichen enthalten enthält bastan contienen give- provide- answer- allow- permit- donnent",
    "source": "passage- source- excerpt- document- filing- page- context- report- material- extract- text- auszüge- unterlagen bericht- extrait- rapport- document- extracto- informe- documento- relatório verslag frage question pregunta request-",
    "beyond": "beyond outside exceed- außerhalb hors fuera fora buiten",
    "sorry": "sorry apolog- regret- leider désolé- siento désolée pardon lamento helaas",
    "i": "i we my assistant ich wir je nous j yo puedo tengo podemos ik eu",
}
#: Refusals as sequences of ideas. A sentence aligns with one if the longest common subsequence of both is the whole template, in one clause.
REFUSALS = [
    "i not tell", "not tell", "not access", "i not access source", "i tell not", "tell i not", "source not hold", "source hold not", "not hold source", "source not", "not source", "not access source", "not source tell",
    "beyond source", "beyond source hold", "sorry beyond", "sorry not", "not access hold source", "hold access not", "tell not", "access not",
]
_TEMPLATES = [t.split() for t in REFUSALS]
_IDEA: dict[str, set[str]] = {}
_STARTS: dict[str, set[str]] = {}
for _name, _text in IDEAS.items():
    for _w in _text.split():
        (_STARTS if _w.endswith("-") else _IDEA).setdefault(_w.rstrip("-"), set()).add(_name)


def ideas(word: str) -> frozenset[str]:
    out = set(_IDEA.get(word, ()))
    for n in range(3, len(word) + 1):
        out |= _STARTS.get(word[:n], set())
    return frozenset(out)


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bit rows."""
    where: dict[str, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full, row = (1 << len(a)) - 1, (1 << len(a)) - 1
    for w in b:
        m = row & where.get(w, 0)
        row = ((row + m) | (row - m)) & full
    return len(a) - bin(row).count("1")


#: The most frequent articles, pronouns, prepositions, conjunctions and auxiliary verbs of each language (fixed values).
FUNCTION_WORDS = {
    "en": "the of and to in a is that it was for on are as with his they at be this from or had by not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has her like him could no than been its who now my over did down only way may any where after most also before such must through does even between both under since while however against during was",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei dieser diese dies wenn etwas kann ich keine kein hoch wir ihr unter jahr",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la avec son ou aux mais comme nous sa leur cette été elle deux ces ses tout même entre sans après avant peu était être fait soit je vous quel quelle cours où donc ni à l d n s",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está mi porque qué sólo han yo hay vez puede todos así nos ni parte tiene él uno donde bien cuál algo",
    "pt": "de a o que e do da em um para é com não uma os no se na por mais as dos como mas foi ao ele das tem à seu sua ou ser quando muito há nos já está eu também só pelo pela até isso ela entre era depois sem mesmo aos ter seus quem nas me esse eles você num pouco",
    "it": "di e il la che in a per un è una sono con non del si da le dei nel alla più al i come della ha gli ma anche lo delle o se su questo nella dal tra era degli questa ci stato ai loro essere suo po",
    "nl": "de van het een en in is dat op te zijn met voor niet die aan er om ook als maar bij door nog uit naar dan ze over tot was wordt worden heeft hebben deze dit meer hij zich werd of kan geen wel al iets jaar wij ik",
    "sv": "och i att det som en på är av för med den till inte har de ett om var jag men sig så från vi kan när år under också mer efter eller nu sin där vid mot ska skulle än något",
    "da": "og i at det er en til på af som for med de den der ikke har et om var sig men fra vi kan jeg så år også efter eller ved blev mod over end noget",
    "no": "og i det på som er en til å av for at med har de ikke den et om var seg men fra vi kan jeg så år også etter eller ved ble mot over enn noe",
    "fi": "ja on ei että se oli hän ovat mutta kun niin myös kuin joka tai sen mukaan hieman enemmän vuonna ole olla sekä jo vain nyt kaikki tämä",
    "pl": "i w na z do nie się to że jest o jak za od po ale a co tym przez być dla był może już tylko jego oraz roku ten więcej niż przed które także są było",
    "tr": "ve bir bu da de için ile çok daha olarak olan gibi kadar sonra en ne var o ki göre önceki yıl değil her ama biraz ise olduğu tarafından",
    "ro": "și de în la a cu pe care nu o un din este pentru că mai sunt se au fost ca sau dar anul după",
    "cs": "a se v na je že o s z do i to k ve pro za by ale si po jako až od jeho byl jsem nebo jsou roku více než",
    "hu": "a az és hogy nem is egy ez volt meg csak már mint de el ha még azt után több évben szerint",
}
_LANG: dict[str, frozenset[str]] = {x: frozenset(w.split()) for x, w in FUNCTION_WORDS.items()}


def language(told: list[str], least: int = 2) -> tuple[str | None, dict[str, int]]:
    """(language, distinct function words of each) of words, if at least so many tell it, and more than tell any other."""
    distinct = set(told)
    score = {x: len(distinct & known) for x, known in _LANG.items()}
    (best, n), (_, second) = sorted(score.items(), key=lambda x: -x[1])[:2]
    return (best if n >= least and n > second else None), score


def scripts(text: str) -> set[str]:
    """The scripts other than Latin of which a text holds three letters and a twelfth of all."""
    letters = 0 if text.isascii() else sum(c.isalpha() for c in text)
    return {name for name, p in _SCRIPTS if letters and len(p.findall(text)) >= max(3, letters / 12)}


#: Columns of the hashed trigrams; trigrams that a model must have seen; nats a trigram by which a sentence may fall short of its language's texts.
COLUMNS, LEAST_SEEN, STRANGE = 1 << 15, 2000, 2.6


def plain_words(text: str) -> list[str]:
    """Words in lower case without those with digits or a capital inside a sentence, which name something; a text in capitals counts as small."""
    letters = [c for c in text if c.isalpha()]
    if letters and sum(c.isupper() for c in letters) > 0.6 * len(letters):
        text = text.lower()
    return [m.group().lower() for m in _PLAIN.finditer(text)]


@lru_cache(maxsize=100_000)
def trigrams(word: str) -> np.ndarray:
    """Columns of the character trigrams of a word."""
    w = f" {word} "
    return np.array([zlib.crc32(w[i : i + 3].encode()) & (COLUMNS - 1) for i in range(len(w) - 2)], np.int64)


_PLAIN = re.compile(r"(?<![^\W_])(?:[^\W\d_A-ZÀ-ÖØ-Þ][^\W\d_]*|(?:(?<=^)|(?<=[.!?¿¡] )|(?<=[¿¡]))[^\W\d_]+)(?![^\W_])")


class Languages:
    """Trigram models of labelled languages; of a fixed number of columns a language, so that they may be broadcast."""

    def __init__(self, texts: dict[str, list[str]]):
        """texts: label -> texts. A text whose function words tell another language than its label is left out."""
        self.logs, self.mean = {}, {}
        for x in sorted(texts):
            split = [plain_words(t) for t in texts[x]]
            split = [w for w in split if language(w)[0] in (x, None)]
            halves = [np.concatenate([np.empty(0, np.int64), *(trigrams(w) for t in split[k::2] for w in t)]) for k in (0, 1)]
            both = np.concatenate(halves)
            if x not in _LANG or len(np.unique(both)) < LEAST_SEEN:
                continue
            unseen = [self._logs(halves[1 - k])[halves[k]] for k in (0, 1)]  # how texts score that were not counted
            self.logs[x], self.mean[x] = self._logs(both), float(np.concatenate(unseen).mean())

    @staticmethod
    def _logs(columns: np.ndarray) -> np.ndarray:
        n = np.bincount(columns, minlength=COLUMNS) + 0.05
        return np.log(n / n.sum()).astype(np.float32)

    def strange(self, told: list[str], asked: str) -> bool:
        """Whether words are unlike the texts of this language; only said of three words and twelve trigrams or more."""
        if asked not in self.logs or len(told) < 3:
            return False
        at = np.concatenate([trigrams(w) for w in told])
        return len(at) >= 12 and float(self.logs[asked][at].mean()) < self.mean[asked] - STRANGE


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    rest = answer
    while (cut := _LEAD.sub("", rest)) != rest:
        rest = cut
    return " ".join(words(_CITE.sub(" ", rest))) in _NOTHING


def is_copied(question: str | None, answer: str) -> bool:
    q, a = words(question or ""), words(_LEAD.sub("", _CITE.sub(" ", answer)))
    if len(q) < 4 or len(a) < 0.7 * len(q):
        return False
    known = {tuple(q[i : i + 3]) for i in range(len(q) - 2)}
    fresh = [i for i in range(len(a) - 2) if tuple(a[i : i + 3]) not in known]
    copies = max(1, round(len(a) / len(q)))
    if len(fresh) > 3 + 2 * (copies - 1) or any(w.isdigit() and w not in q for w in a):
        return False
    return lcs(q, a) >= 0.8 * len(q)


def aligned(clause: list[str]) -> bool:
    """Whether the words hold the ideas of a refusal template in their order."""
    held = [x for x in map(ideas, clause) if x]
    for t in _TEMPLATES:
        at = 0
        for x in held:
            if at < len(t) and t[at] in x:
                at += 1
        if at == len(t):
            return True
    return False


def is_refusal(question: str | None, answer: str) -> bool:
    plain = _CITE.sub(" ", answer)
    asked = set(words(question or ""))
    if any(c.isdigit() for x in words(plain) if x not in asked for c in x):
        return False  # it states something
    return any(aligned(words(s)) for s in re.split(r"(?<=[.!?;:。])\s+|,\s+(?:so|but|and|because|although|while)\b", plain))


_QUOTED = re.compile(r"[«“\"„].*?[»”\"“]")


def wrong_language(question: str | None, answer: str, models: Languages) -> bool:
    plain = _QUOTED.sub(" ", question or "")
    if not words(plain):
        return False
    told, asked = scripts(plain), set(words(question or ""))
    known, score = language(words(plain), 1)
    if known is None:  # function words leave it open: of the languages that tie, one whose texts look like it
        known = next((x for x in models.logs if score[x] and score[x] == max(score.values()) and not models.strange(plain_words(plain), x)), None)
    for s in [s for s in re.split(r"(?<=[.!?;])\s+|(?<=。)", _CITE.sub(" ", answer)) if s.strip()]:
        other = scripts(s)
        if bool(other) != bool(told) and (other or len(plain_words(s)) >= 3) or (other and told and not other & told):
            return True
        if known is None:
            continue
        _, score = language([w for w in words(s) if w not in asked or w in _LANG[known]])
        if max(score.values()) - score[known] >= 2:
            return True
        fresh = [w for w in plain_words(s) if w not in asked]
        if score[known] <= 1 and models.strange(fresh, known):
            return True
    return False


def broken_end(answer: str) -> str:
    """'yes' where the form alone shows that the text breaks off, 'no' where it is ended, else 'ask'."""
    text = answer.rstrip()
    if re.search(r"[\[(（［【][^\])）］】]*$", text) and not re.search(r"[\])]\s*[.!?]?$", text):
        return "yes"
    cited = bool(re.search(r"[\]］】]\s*$", text))
    core = _CITE.sub("", text).rstrip() if cited else text
    if re.search(r"(?:…|\.\.\.)[\"'”’)]*$", core):
        return "yes"
    if re.search(r"[.!?。！？][\"'”’»)]*$", core) or cited:
        return "no"
    if re.search(r"[-–—,;:/&+]$", core):
        return "yes"
    w = core.split()
    if len(w) <= 5 and any(c.isdigit() for c in core):
        return "no"  # a bare figure
    return "ask"


def _judge(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models = shared.value
        for p in batches:
            kinds = []
            for q, a, can in zip(p["question"], p["answer"], p["answerable"], strict=True):
                end = "no"
                if is_empty(a):
                    kind = "empty"
                elif is_copied(q, a):
                    kind = "copied"
                elif is_refusal(q, a):
                    kind = "refusal" if can is None or bool(can) else ("wrong_language" if wrong_language(q, a, models) else None)
                else:
                    end = broken_end(a)
                    kind = "truncated" if end == "yes" else "wrong_language" if wrong_language(q, a, models) else None
                kinds.append((kind, end == "ask"))
            yield pd.DataFrame({"k1": p["k1"], "k2": p["k2"], "answer": p["answer"], "kind": [k for k, _ in kinds], "ask": [x for _, x in kinds]})

    return run


def learn_languages(texts: DataFrame, text: str, lang: str, *, per_language: int = 300, most_languages: int = 50, chars: tuple[int, int] = (200, 4000)) -> Languages:
    """Models of the labelled languages, from at most `per_language` texts of a length within `chars` for each of `most_languages` labels.

    Labels are read without case; null, empty and "und" labels are none. Texts that clearly are of another
    language than their label take no part.
    """
    name = F.lower(F.trim(F.col(lang)))
    rows = texts.select(name.alias("lang"), F.col(text).alias("text")).where("lang IS NOT NULL AND lang NOT IN ('', 'und')").where(F.length("text").between(*chars))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("text"), "text")
    sample = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_language)
    found: dict[str, list[str]] = {}
    for r in sample.orderBy("_n", "lang").limit(per_language * most_languages).select("lang", "text").collect():
        if r["lang"] in found or len(found) < most_languages:
            found.setdefault(r["lang"], []).append(r["text"])
    return Languages(found)


def _tokens(text):
    """Lower-cased words with figures as '#', and marks that end a statement as '.'; a citation counts as such a mark."""
    t = F.regexp_replace(F.lower(text), r"\s*\[[\d,; ]+\]", " . ")
    t = F.regexp_replace(t, r"\d+(?:[.,]\d+)*", "#")
    return F.regexp_extract_all(t, F.lit(r"(?:[\p{L}#][\p{L}\p{M}#'’-]*|[.;!?。])"), F.lit(0))


def defective_pairs(df: DataFrame, key1: str, key2: str, question: str, answer: str, answerable: str, languages: Languages | None = None) -> DataFrame:
    """(key1, key2, defect): one row for each defective pair; languages: see learn_languages(), without them only scripts are told apart.

    A pair delivered twice counts once; rows with a null key are left out. A null answer is empty; a
    null question can neither be copied nor tell a language; a null answerable counts as answerable.
    Declining where answerable is false is no defect. An empty table gives no row.
    """
    kinds = dict(df.dtypes)
    rows = df.select(F.col(key1).alias("k1"), F.col(key2).alias("k2"), F.col(question).alias("question"), F.col(answer).alias("answer"), F.col(answerable).alias("answerable"))
    rows = rows.where("k1 IS NOT NULL AND k2 IS NOT NULL").dropDuplicates(["k1", "k2"])
    models = df.sparkSession.sparkContext.broadcast(languages or Languages({}))
    judged = rows.mapInPandas(_judge(models), f"k1 {kinds[key1]}, k2 {kinds[key2]}, answer string, kind string, ask boolean")
    # How often each pair of words, and each word, is followed by an end or by another word, over all answers.
    seq = rows.where("answer IS NOT NULL").select(F.concat(F.array(F.lit("^")), _tokens(F.col("answer"))).alias("t")).where("size(t) >= 3")
    steps = seq.select(F.explode(F.expr("transform(sequence(2, size(t) - 1), i -> struct(t[i - 2] AS a, t[i - 1] AS b, t[i] RLIKE '^[.;!?。]$' AS ends))")).alias("s")).select("s.*").where("b NOT RLIKE '^[.;!?。]$'")
    two = steps.groupBy("a", "b").agg(F.count_if("ends").alias("ends2"), F.count("*").alias("n2"))
    one = two.groupBy("b").agg(F.sum("ends2").alias("ends1"), F.sum("n2").alias("n1"))
    t = _tokens(F.col("answer"))
    asked = judged.where("ask").select("k1", "k2", "kind", F.when(F.size(t) >= 2, F.element_at(t, -2)).otherwise("^").alias("a"), F.when(F.size(t) >= 1, F.element_at(t, -1)).alias("b"))
    asked = asked.join(two, ["a", "b"], "left").join(one, "b", "left")
    ended = F.when(F.coalesce("n2", F.lit(0)) >= 2, F.col("ends2") / F.col("n2") >= 0.05).otherwise(F.coalesce(F.col("ends1") / F.col("n1") >= 0.2, F.lit(False)))
    asked = asked.select("k1", "k2", F.when(ended, F.col("kind")).otherwise("truncated").alias("kind"))
    out = judged.where("NOT ask").select("k1", "k2", "kind").unionAll(asked).where("kind IS NOT NULL")
    return out.select(F.col("k1").alias(key1), F.col("k2").alias(key2), F.col("kind").alias("defect"))
