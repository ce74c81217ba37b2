"""Defects of prompt and response pairs by ordered rules; every rule that applies is emitted.

The rules, in order: emptiness, unclosed delimiters and abrupt endings, phrases that decline in several languages, copied questions and
copied prefixes of them, and a script or language unlike the question's. Nothing but an empty answer ends the list; a copy has
no words of its own, so that the rules on what an answer says find nothing in it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What stands where nothing is said.
EMPTY = frozenset("null none nil n/a na n.a. nan undefined empty tbd todo keine ninguna aucune answer antwort respuesta réponse noanswer no answer leer vacío vide".split()) - {"no"} | {
    "no answer", "no response", "not available", "not applicable", "(no answer)", "keine antwort", "sin respuesta", "pas de réponse", "无", "没有回答", "कोई उत्तर नहीं",
}

#: Phrases that decline to answer, by language.
_HELP = r"(?:help|assist|answer|respond|reply|discuss|comment|advise|talk|say|share|speak|go\s+into|go\s+there|give|giving|provide|support\s+(?:you|this|that)|engage|offer)"
#: Each with the words one of which a text must have for its patterns to be tried; none for scripts whose words are not told apart.
REFUSALS = [
    (
        "i we me us sorry afraid regret unfortunately apologise apologize unable cannot won t able allowed permitted decline refuse prefer comment inappropriate subject policy policies guidelines instructions rules programming answer assist discuss",
        [
            rf"\bI(?:'m|\s+am)?\s+(?:sorry,?\s+(?:but\s+)?)?(?:I\s+)?(?:really\s+|simply\s+)?(?:can(?:'t|not|\s+not)|could(?:n't|\s+not)|won't|will\s+not|would\s+rather\s+not|do(?:n't|\s+not)|am\s+not\s+(?:able|allowed|permitted)\s+to|unable\s+to|not\s+(?:able|allowed|permitted)\s+to)\s+{_HELP}\b",
            # Without a subject only where the sentence begins or an excuse leads: a device that cannot provide something is an answer.
            rf"(?:^|[.!?:;\n]\s*|\b(?:sorry|afraid|regret|apologi[sz]e|unfortunately),?\s+(?:but\s+)?)(?:we\s+)?(?:can(?:'t|not)|won't|will\s+not|unable\s+to|not\s+(?:able|allowed|permitted)\s+to)\s+{_HELP}\b[^.]{{0,25}}\b(?:question|request|topic|that|this|here)\b",
            rf"\b(?:I(?:'m|\s+am)|we(?:'re|\s+are))\s+not\s+(?:going\s+to|willing\s+to|prepared\s+to|in\s+a\s+position\s+to|comfortable\s+with)\s+(?:{_HELP}|get(?:ting)?\s+into|answering|discussing|touch)\b",
            r"\b(?:must|have\s+to|need\s+to|prefer\s+to)\s+(?:respectfully\s+)?(?:decline|refuse)\b",
            r"\bI\s+(?:decline|refuse)\s+to\b",
            rf"\bI(?:'d|\s+would|\s+do)?\s+(?:rather|prefer)\s+not\b",
            rf"\b(?:instructions|rules|guidelines|policy|policies|programming)\s+(?:prevent|forbid|prohibit|stop|keep|do(?:es)?\s+not\s+allow)\w*\s+(?:me|us)\b",
            r"\binappropriate\s+for\s+me\b",
            rf"\bnot\s+something\s+(?:that\s+)?I(?:'m|\s+am)?\s*(?:can|able)\b",
            r"\bno\s+comment\s+(?:from|on)\b",
            r"\bI(?:'m|\s+am)\s+unable\s+to\s+(?:provide|offer|give|answer|help|assist|comment)\b",
            r"\bas\s+an?\s+(?:AI|assistant|language\s+model)\b[^.]{0,40}\b(?:not|can't|decline|unable)\b",
            r"\bchange\s+the\s+subject\b",
        ],
    ),
    (
        "puedo prefiero permitido permitida niego quiero voy deseo",
        [
            r"\bno\s+puedo\s+(?:ayudar|responder|contestar|opinar|hablar|dar|comentar)|\bprefiero\s+no\s+(?:contestar|responder|opinar|hablar)|\bno\s+(?:me\s+)?(?:está|es)\s+permitid\w+\s+(?:responder|contestar|hablar)|\bme\s+niego\b|\bno\s+(?:quiero|voy\s+a|deseo)\s+(?:contestar|responder)",
        ],
    ),
    (
        "peux puis veux souhaite sujet préfère refuse autorisé autorisée",
        [
            r"\bne\s+(?:peux|puis|veux|souhaite)\s+pas\s+(?:vous\s+)?(?:répondre|aider|commenter|donner|en\s+parler|fournir)|\bsujet\s+m'est\s+interdit|\bpréfère\s+ne\s+pas\b|\brefuse\s+de\s+répondre|\bpas\s+autorisée?\s+à\s+(?:répondre|parler)",
        ],
    ),
    (
        "ich",
        [
            r"\bkann\s+ich\s+(?:\w+\s+){0,3}(?:keine?n?\s+(?:auskunft|antwort|hilfe|rat)|nicht\s+(?:helfen|beantworten|antworten))|\bmöchte\s+ich\s+(?:\w+\s+){0,2}nicht\s+(?:beantworten|antworten|sprechen|kommentieren)|\bich\s+(?:kann|darf|möchte|werde)\s+(?:\w+\s+){0,4}nicht\s+(?:helfen|beantworten|antworten|sprechen)|\bdarf\s+ich\s+(?:\w+\s+){0,3}(?:nicht|keine)\b",
        ],
    ),
    (
        "posso possiamo voglio intendo preferisco rifiuto permesso consentito",
        [
            r"\bnon\s+(?:posso|possiamo|voglio|intendo)\s+(?:rispondere|aiutar\w*|commentare|parlarne|discutere|fornire\s+(?:assistenza|consigli))|\bpreferisco\s+non\b|\bmi\s+rifiuto\b|\bnon\s+mi\s+è\s+(?:permesso|consentito)\b",
        ],
    ),
    (
        "posso podemos quero vou irei consigo prefiro recuso permitido estou tenho",
        [
            r"\bnão\s+(?:posso|podemos|quero|vou|irei|consigo)\s+(?:responder|ajudar|comentar|falar|discutir|fornecer\s+(?:ajuda|conselhos))|\bprefiro\s+não\b|\brecuso-me\b|\bme\s+recuso\b|\bnão\s+me\s+é\s+permitido\b|\bnão\s+(?:estou|tenho)\s+(?:autorizad\w+|permissão)\b",
        ],
    ),
    (
        "ik",
        [
            r"\b(?:kan|mag|wil|zal)\s+ik\s+(?:\w+\s+){0,3}niet\b[^.]{0,20}(?:helpen|beantwoorden|antwoorden|bespreken)|\bik\s+(?:kan|mag|wil|zal)\s+(?:\w+\s+){0,4}(?:niet|geen)\b[^.]{0,25}(?:helpen|beantwoorden|antwoorden|antwoord|bespreken|ingaan|commentaar)|\bik\s+weiger\b",
        ],
    ),
    (
        "mogę możemy chcę będę odmawiam wolę wolno",
        [
            r"\bnie\s+(?:mogę|możemy|chcę|będę)\s+(?:\w+\s+){0,2}(?:odpowiedzieć|odpowiadać|pomóc|komentować|rozmawiać|udzielić)|\bodmawiam\b|\bwolę\s+nie\b|\bnie\s+wolno\s+mi\b",
        ],
    ),
    (
        "jag jeg",
        [
            r"\bjag\s+(?:kan|får|vill|kommer)\s+(?:\w+\s+){0,2}inte\s+(?:att\s+)?(?:\w+\s+)?(?:svara|hjälpa|kommentera|diskutera)|\bjeg\s+(?:kan|må|får|vil)\s+(?:\w+\s+){0,2}ikke\s+(?:\w+\s+)?(?:svare|hjelpe|hjælpe|kommentere|diskutere|besvare)",
        ],
    ),
    (
        "",
        [
            r"не\s+(?:могу|можем|буду)\s+(?:\w+\s+){0,2}(?:ответить|отвечать|помочь|комментировать|обсуждать)|отказываюсь|回答できません|お答えできません|답변(?:할|드릴)\s*수\s*없",
            r"无法(?:回答|提供|协助|帮助|讨论)|不能(?:回答|讨论|帮助)|拒绝回答|不便(?:回答|透露)|抱歉，?我",
            r"(?:उत्तर|जवाब|मदद|सहायता|टिप्पणी)\s*(?:नहीं|देने\s*में\s*असमर्थ)|नहीं\s*(?:दे|कर)\s*सकत",
        ],
    ),
]
_REFUSALS = [(frozenset(words.split()), re.compile("|".join(patterns), re.I)) for words, patterns in REFUSALS]
#: What such phrases may speak of without declining.
NO_REFUSAL = re.compile(r"\b(?:not\s+able\s+to\s+see|can(?:'t|not)\s+(?:recommend|be)|not\s+(?:in|part\s+of|covered\s+by)\s+the\s+approved)\b", re.I)

#: Frequent words of grammar by language; a word of several languages tells as much less of each.
WORDS = {
    "en": "the of and to in is that it for on with as are this be at or from by an not which have was were if when will can should has its there their they you your we our but than then before after between into over until while each any all do does how what why who where no",
    "de": "der die das und ist nicht mit für auf ein eine einen einem einer den dem des zu zum zur von vom im in bei nach vor über unter zwischen wenn dass als auch wie was wer wo warum wird werden wurde sind hat haben kann können muss müssen soll sollte nur noch oder aber durch ohne bis aus an am es sich wir ich sie ihr ihre man bitte welche welcher welches diese dieser dieses obwohl sobald bleibt",
    "es": "el la los las un una unos unas de del al que y en es son por para con sin sobre entre cuando como qué cuál cuánto cuántos cada se su sus no lo le les está están hay ser debe deben puede pueden más muy antes después durante mientras aunque hasta desde este esta estos estas ha han hemos nuestro nuestra todo todos toda todas también donde tras bajo debajo",
    "fr": "le la les un une des du de au aux et est sont que qui dans pour par sur sous avec sans entre quand lorsque comme quel quelle quels quelles combien ce cet cette ces il elle ils elles on nous vous je ne pas plus se sa son ses leur leurs être doit doivent peut peuvent faut avant après pendant jusqu même si notre votre nos vos tout tous toute toutes aussi très où donc car",
    "pt": "o a os as um uma uns umas de do da dos das em no na nos nas ao à que e é são por para com sem sobre entre quando como qual quanto cada se seu sua seus suas não está estão há ser deve devem pode podem mais muito antes depois durante enquanto embora até desde este esta isto você foi",
    "it": "il lo la i gli le un uno una di del dello della dei degli delle al allo alla ai alle da dal dalla nel nella in con su sul sulla per tra fra che e è sono non si come quando quale quanto ogni anche più prima dopo durante mentre se deve devono può possono essere questo questa questi viene",
    "nl": "de het een en van in op te voor met is zijn niet dat die deze dit aan bij uit naar over onder tussen door tot als wanneer hoe wat welke waar waarom wordt worden moet moeten kan kunnen ook nog maar of om er je u wij we zij ik heeft hebben na",
    "pl": "i w z na do od po za przez dla nie jest są się że to ten ta te jak kiedy który która które czy co gdzie dlaczego można należy musi może przed między podczas jeśli gdy oraz lub ale jego jej ich o ze we",
    "sv": "och att det som en ett är för på med av till den inte om i från när hur vad vilken vilket var varför kan ska måste bör har under mellan efter före vid eller men också sig de vi du man",
    "da": "og at det som en et er for på med af til den ikke om i fra når hvordan hvad hvilken hvor hvorfor kan skal må bør har under mellem efter før ved eller men også sig de vi du man",
    "no": "og å det som en et er for på med av til den ikke om i fra når hvordan hva hvilken hvor hvorfor kan skal må bør har under mellom etter før ved eller men også seg de vi du man",
    "fi": "ja on ei se että kun jos tai mutta myös kuin niin ovat voi pitää täytyy ennen jälkeen välillä aikana mikä mitä miten missä miksi joka jotka tämä nämä sen sitä ole",
    "cs": "a v na se je že s z do pro o jako když nebo ale jsou není který která které co jak kde proč může musí před po mezi při také byl být ze si",
    "ro": "și în la de cu pe pentru din este sunt nu se că un o al ale care când cum ce unde poate trebuie înainte după între sau dar mai prin",
    "tr": "ve bir bu için ile de da ne nasıl nerede neden olan olarak gibi kadar sonra önce veya ama değil mi mı var yok her daha",
    "hu": "a az és nem hogy egy is van vannak ha vagy de mint amikor hogyan mi mit hol miért kell lehet előtt után között alatt ez ezek meg csak",
}
#: Letters that few languages have.
SIGNS = {
    "ñ": "es", "¿": "es", "¡": "es", "á": "es pt cs hu", "í": "es pt cs hu", "ó": "es pt pl cs hu", "ú": "es pt cs hu", "ß": "de", "ä": "de sv fi", "ö": "de sv fi tr hu", "ü": "de tr hu", "ç": "fr pt tr", "œ": "fr", "à": "fr it pt",
    "è": "fr it", "ê": "fr pt", "û": "fr", "î": "fr ro", "ô": "fr pt", "ë": "fr nl", "ã": "pt", "õ": "pt", "ò": "it", "ù": "it fr", "ì": "it", "ł": "pl", "ż": "pl", "ś": "pl", "ć": "pl", "ę": "pl", "ą": "pl", "å": "sv da no", "ø": "da no", "æ": "da no",
    "ř": "cs", "ě": "cs", "ů": "cs", "ž": "cs", "š": "cs", "č": "cs", "ă": "ro", "ș": "ro", "ț": "ro", "â": "ro fr pt", "ğ": "tr", "ş": "tr", "ı": "tr", "ő": "hu", "ű": "hu",
}


def _weights() -> dict[str, list[tuple[str, float]]]:
    of: dict[str, list[str]] = {}
    for name, words in WORDS.items():
        for w in words.split():
            of.setdefault(w, []).append(name)
    # Single letters stand in units and names as often as in sentences.
    return {w: [(name, 1 / len(names)) for name in names] for w, names in of.items() if len(w) > 1}


_TELLS = _weights()
_SIGNED = {sign: [(name, 0.7 / len(names.split())) for name in names.split()] for sign, names in SIGNS.items()}
LETTER = re.compile(r"[^\W\d_]")
SCRIPTS = [(n, re.compile(b)) for n, b in (("ja", "[぀-ヿ]"), ("zh", "[㐀-鿿]"), ("hi", "[ऀ-ॿ]"), ("ru", "[Ѐ-ӿ]"), ("ar", "[؀-ۿ]"), ("ko", "[가-힯]"), ("el", "[Ͱ-Ͽ]"), ("he", "[֐-׿]"), ("th", "[฀-๿]"))]
#: What French and Italian leave out before a vowel.
ELISION, ELIDED = re.compile(r"\b(?:l|d|qu|n|m|s|j|c)'[a-zéèêh]|-t-(?:il|elle)"), re.compile(r"\b(?:dell|nell|all|sull|dall|un|quell)'[a-zèh]")
ENDED = re.compile(r"(?:[.!?。！？।…]|:-?\))[\"'”’»)\]」』*_~]*$")
ABBREVIATED = re.compile(r"\w\s+(?:no|nos|approx|e\.g|i\.e|ca|z\.B|bzw|vgl|cf|fig|incl|resp|max|min)\.$")
MARKER = re.compile(r"^\s*(?:[-*•–]|\(?\d{1,3}[.)])(?:\s+|$)")
CODE = r"[A-Z]{1,4}-?\d[\w\-./]*"
#: Codes, which are none of a language's words, and words.
SPOKEN = re.compile(rf"\b{CODE}\b|[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """The words of a text in lower case, without codes and amounts."""
    return [t.lower() for t in SPOKEN.findall(text) if t.isalpha()]


def language(text: str, words: list[str] | None = None) -> str | None:
    """The language of a text by script, then by short words and letters; None if they don't tell."""
    if not text.isascii():
        letters = len(LETTER.findall(text))
        for name, block in SCRIPTS:
            if len(block.findall(text)) > 0.3 * letters:
                return name if letters else None
    words = words_of(text) if words is None else words
    score: dict[str, float] = {}
    for w in _TELLS.keys() & set(words):
        times = words.count(w)
        for name, weight in _TELLS[w]:
            score[name] = score.get(name, 0.0) + weight * times
    if not text.isascii() or "'" in text:
        low = text.lower().replace("’", "'")
        for sign in _SIGNED.keys() & set(low):
            times = min(2, low.count(sign))
            for name, weight in _SIGNED[sign]:
                score[name] = score.get(name, 0.0) + weight * times
        if "'" in low:
            score["fr"] = score.get("fr", 0.0) + 0.8 * len(ELISION.findall(low))
            score["it"] = score.get("it", 0.0) + 0.8 * len(ELIDED.findall(low))
    best, *rest = sorted(score.values(), reverse=True)[:2] or (0.0,)
    if best < 1.0 or rest and best <= 1.25 * rest[0]:
        return None
    return max(score, key=score.__getitem__)


def _plain(text: str) -> str:
    return UNSPOKEN.sub("", (text if text.isascii() else unicodedata.normalize("NFKC", text)).lower())


UNSPOKEN = re.compile(r"[\W_]+")
_asked = lru_cache(50_000)(_plain)


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    text = answer if len(answer) > 200 and answer.isascii() and "<" not in answer and "&" not in answer else UNSEEN.sub(" ", answer)
    text = text.strip(" \t\r\n\xa0.,:;!?*#_~`|/\\-–—…'\"()[]{}<>")
    return not SAID.search(text) or len(text) < 40 and text.lower() in EMPTY


UNSEEN, SAID = re.compile(r"<[^<>]*>|&nbsp;|[​-‏⁠﻿­]"), re.compile(r"\w")
#: What may lead a copied question.
LEADS = ("", "question", "answer", "youasked", "youaskedme", "q", "a", "yourquestion", "yourquestionwas")


def is_copy(question: str | None, answer: str) -> bool:
    """Whether an answer is the question, once or more often or its first part, with nothing but quoting around it."""
    q = _asked(question or "")
    if not q:
        return False
    # Most answers begin unlike the question; of these nothing but the beginning is looked at.
    head = _plain(answer[:160])
    if len(head) >= 40 and not any(head.removeprefix(lead).startswith(q[:16]) for lead in LEADS):
        return False
    a = _plain(answer)
    if is_prefix(q, a):
        return True
    for lead in LEADS:
        rest = a.removeprefix(lead)
        if rest and len(rest) % len(q) == 0 and rest == q * (len(rest) // len(q)):
            return True
    return False


def is_prefix(q: str, a: str) -> bool:
    """Whether a plain answer is a copied prefix of a plain question: shorter, but most of it."""
    return 12 <= len(a) < len(q) <= 2 * len(a) and q.startswith(a)


def is_value(text: str) -> bool:
    """A code, an amount or a few of them: whole without an end mark."""
    t = text.strip()
    if re.fullmatch(rf"(?:(?:code|yes|no|ja|nein|sí|oui|non)[,:]?\s+)?{CODE}", t, re.I):
        return True
    if re.fullmatch(r"(?:yes|no|ja|nein|sí|si|oui|non)", t, re.I):
        return True
    if re.fullmatch(r"[+\-±<>≤≥~]?\s*\d[\d.,\s]*(?:\s*(?:%|[A-Za-zµ°²³/%]{1,8})(?:\s*(?:v/v|LEL|vol))?)?(?:\s*(?:-|–|to)\s*\d[\d.,]*\s*\S{0,8})?", t):
        return True
    words = t.split()
    return len(words) <= 4 and bool(re.search(r"\d", words[0]) or (words[0].isupper() and len(words[0]) > 1)) and (len(words) < 3 or words[1].lower() in ("and", "or", "/", "+", "&", "und", "y", "et")) and len(words[-1]) > 2


def is_truncated(answer: str) -> bool:
    """Whether an answer breaks off inside a word, sentence, list or table."""
    text = answer.replace("​", "").rstrip()
    if not text:
        return False
    if text.count("```") % 2:
        return True
    lines = text.split("\n")
    last = lines[-1].strip()
    if last.startswith("|") or sum(ln.strip().startswith("|") for ln in lines) > 1:
        rule = re.fullmatch(r"\|?[\s:|\-]+\|?", last) is not None
        cells = lines[0].count("|")
        return not last.endswith("|") or rule or (len(last) > 1 and last.count("|") < cells) if last.startswith("|") else not (ENDED.search(last))
    if m := MARKER.match(last):
        item = last[m.end() :].strip()
        if not item:
            return True
        others = [ln.strip()[k.end() :].strip() for ln in lines[:-1] if (k := MARKER.match(ln.strip()))]
        if others:
            if all(ENDED.search(o) for o in others):
                return not ENDED.search(item)
            if all(":" in o for o in others):
                return ":" not in item or not item.split(":", 1)[1].strip()
            return bool(re.search(r"[,:;(\-–]$", item))
    if is_value(text):
        return False
    if text.count("(") - len(re.findall(r"[:;]-?\(", text)) > text.count(")") - len(re.findall(r"[:;]-?\)", text)):
        return True
    if ABBREVIATED.search(text):
        return True
    if text.endswith((")", "]")) and not text.endswith((":)", ";)")) and len(text) > 1:
        return False
    return not ENDED.search(text)


def is_refusal(text: str, words: list[str] | None = None) -> bool:
    """Whether a text declines to answer."""
    words = set(words_of(text) if words is None else words)
    for triggers, pattern in _REFUSALS:
        if (triggers and not triggers.isdisjoint(words) or not triggers and not text.isascii()) and pattern.search(NO_REFUSAL.sub(" ", text)):
            return True
    return False


def defects(question: str | None, answer: str | None) -> list[str]:
    """All defects of a pair in the order of the rules."""
    if is_empty(answer):
        return ["empty"]
    found = []
    copied = is_copy(question, answer)
    # What a copy says is the question's: of it only the question broken off tells something of the answer.
    if is_truncated(answer) if not copied else is_prefix(_asked(question), _plain(answer)):
        found.append("truncated")
    # What the question says, repeated before the answer, is not the answer's.
    said = "" if copied else answer.replace(question.strip(), " ") if question and question.strip() else answer
    said = said.replace("’", "'")
    words = words_of(said)
    if is_refusal(said, words):
        found.append("refusal")
    if copied:
        found.append("copy")
    if sum(map(len, words)) >= 8:
        asked, answered = _language(question or ""), language(said, words)
        if answered and asked and answered != asked:
            found.append("language")
    return found


_language = lru_cache(50_000)(language)


def broken_pairs(pairs: DataFrame, id_col: str = "id", question_col: str = "question", answer_col: str = "answer", key_name: str = "feedback_id") -> DataFrame:
    """``(key_name, defect)``: every defect of every pair, each once for an id.

    A null or blank answer is empty; a null question takes part in no comparison; verdicts and further columns are
    not read. Rows delivered again under one id are made one after the rules, on the few rows with a
    defect and map-side first, so that neither texts nor a frequent question are shuffled.
    """
    src = pairs.select(F.col(id_col).alias(key_name), question_col, answer_col)
    kind = T.StructType([src.schema[key_name], T.StructField("defect", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = pa.array([defects(q, a) for q, a in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)], pa.list_(pa.string()))
            parents = pc.list_parent_indices(each)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(parents), each.flatten()], kind.names)

    return src.mapInArrow(run, kind).distinct()
