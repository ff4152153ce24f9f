"""Defective prompt and response pairs: empty, truncated, refused, copied, in another language.

* truncation: a pushdown parser over fences, brackets, quotations, list items
  and markup finds what is left open; the last word is held against how often
  the corpus ends a sentence with it, and against words it is cut from;
* copies: greedy string tiling of the words of prompt and response;
* language: scripts, and trigram profiles learnt from labelled texts (function
  words where there are none);
* refusals: a grammar of openers, subjects, negated modals and task verbs.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Mapping

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorate.llm.lookalike import Rewriter, frequencies, rewriter_of
from quorate.llm.profiles import Profiles, learn
from quorate.llm.shared import Shared
from quorate.staging import stage

#: Placeholders for no content.
PLACEHOLDERS = {"", "na", "n a", "nan", "none", "null", "nil", "empty", "blank", "no response", "no output", "no answer", "no content", "not applicable", "tbd", "todo", "undefined", "missing", "empty string", "no text", "placeholder", "void", "no reply"}

#: Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the and of to in that is are was were be been it for on with as at by this these those we our they their you your not but or if so while because from an have has had will would about before after who what which when until unless every both since than all just there here my us them out up no can't don't it's i'm how why any more most into over only even though",
    "es": "el los las que y en un una por con para del se no su al es lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante nadie siempre otra vez según qué después mañana aquí",
    "fr": "le les des et en du une est que qui dans pour pas sur au avec il ne se ce par plus on mais sont aux nous vous cette leur son sa ses ont été même comme sans si ou où tout bien aussi encore toujours après déjà personne je",
    "de": "der die das und ist nicht ein eine zu den mit von auf für im sich des dem wie auch als an werden aus er hat dass sie nach wird bei einer um am sind noch einem über einen so zum war haben nur oder aber vor zur bis mehr durch man wir ich gegen schon wenn warum heute wieder ohne",
    "pt": "o os as que e em um uma para com não por mais dos como mas foi ao ele das tem à seu sua ou ser quando muito há nos já está eu também só pelo pela até isso ela entre era depois sem mesmo aos ter seus quem nas me esse eles você dizem sei agora sempre outra vez é",
    "it": "il lo gli che di e la per un una in non con del della sono si come da più ma anche al alla dei nel nella questo ha le ci se ho è perché quando molto dopo senza sempre tutti ancora",
    "nl": "de het een en van ik te dat die in is niet op aan met voor zijn er maar om hem dan zou wat mijn men dit zo door over ze zich bij ook tot je mij uit der daar haar naar heb hoe heeft hebben deze want nog zal ons geen wij",
    "pl": "i w na z nie się do to że jest o jak ale po co tak za od jego już tylko być może dla czy przez są było ma przed też kiedy gdzie bez pod nad więc ten ta te znów jutro dlaczego oni ich nikt zawsze który która dziś",
}
_WORDS_OF = {name: frozenset(words.split()) for name, words in FUNCTION_WORDS.items()}
#: Letters that tell languages in Latin letters apart.
_LETTERS_OF = {"es": "ñ¿¡", "pt": "ãõ", "de": "ßäöü", "pl": "ąęłśźżćń", "fr": "œêèâîûëïùç"}

SCRIPTS = {name: regex.compile(p) for name, p in {"cyrillic": r"\p{Cyrillic}", "japanese": r"[\p{Hiragana}\p{Katakana}]", "han": r"\p{Han}", "korean": r"\p{Hangul}", "arabic": r"\p{Arabic}", "hebrew": r"\p{Hebrew}", "greek": r"\p{Greek}", "thai": r"\p{Thai}", "indic": r"[\p{Devanagari}\p{Bengali}\p{Tamil}]", "latin": r"\p{Latin}"}.items()}

WORD = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]|[\p{L}\p{M}\p{N}]+(?:['’\-][\p{L}\p{M}\p{N}]+)*")
STOP = ".!?…。！？"
TOKEN = regex.compile(rf"{WORD.pattern}|[{STOP}]+|[^\w\s]")
TAIL = regex.compile(r"(?:\s*(?:#[\p{L}\p{N}_]+|https?://\S+|[\p{Extended_Pictographic}\p{Emoji_Modifier}‍️]+))+\s*$")
LINK = regex.compile(r"(?:https?://|www\.)\S+")
REPOST = regex.compile(r"\b(?:rt|via)\s+@[\w.-]+:?", regex.I)


def language(text: str) -> str | None:
    """The main script, or among Latin letters the language; None if that cannot be told."""
    text = REPOST.sub(" ", LINK.sub(" ", text))
    letters = {name: len(p.findall(text)) for name, p in SCRIPTS.items()}
    if not sum(letters.values()):
        return None
    if letters["japanese"]:
        letters["japanese"] += letters.pop("han")
    # A syllable sign or ideograph stands for a few Latin letters.
    for name in ("japanese", "han", "korean"):
        letters[name] = 3 * letters.get(name, 0)
    script = max(letters, key=lambda k: letters[k])
    if script != "latin":
        return script
    words = [w.lower().replace("’", "'") for w in WORD.findall(text)]
    score = {name: sum(w in own for w in words) + sum(min(3, text.lower().count(c)) for c in _LETTERS_OF.get(name, "")) for name, own in _WORDS_OF.items()}
    order = sorted(score, key=lambda k: -score[k])
    if score[order[0]] < 2 or score[order[0]] < 1.25 * score[order[1]]:
        return None
    return order[0]


class Runs:
    """Suffix automaton of a word sequence: the longest run that ends at each place of another one."""

    def __init__(self, words: list[str | int]):
        self.next: list[dict] = [{}]
        self.link, self.length, self.end = [-1], [0], [0]
        last = 0
        for i, w in enumerate(words):
            here = len(self.next)
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            self.end.append(i)
            p = last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = here
                p = self.link[p]
            if p >= 0:
                q = self.next[p][w]
                if self.length[p] + 1 == self.length[q]:
                    self.link[here] = q
                else:
                    twin = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.length.append(self.length[p] + 1)
                    self.link.append(self.link[q])
                    self.end.append(self.end[q])
                    while p >= 0 and self.next[p].get(w) == q:
                        self.next[p][w] = twin
                        p = self.link[p]
                    self.link[q] = self.link[here] = twin
            last = here

    def ending(self, words: list[str | int]) -> Iterator[tuple[int, int, int]]:
        """(length, end here, end there) of the longest run that ends at each place."""
        state = n = 0
        for i, w in enumerate(words):
            while state and w not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if w in self.next[state]:
                state = self.next[state][w]
                n += 1
            else:
                n = 0
            yield n, i, self.end[state]


def tiled(a: list[str], b: list[str], shortest: int = 3) -> int:
    """Words of ``a`` covered by greedy tiles of ``b``: longest common runs first, each word used once.

    A round lays all tiles of at least half the longest run, longest first, and
    takes their words out; rounds go on until no run is long enough. A round is
    linear, and the longest run of the next one is shorter by half or was barred
    by a tile, so repetitive texts need few rounds.
    """
    a, b = list(a), list(b)
    covered = 0
    while True:
        found = sorted((t for t in Runs(b).ending(a) if t[0] >= shortest), reverse=True)
        if not found:
            return covered
        used_a, used_b = [False] * len(a), [False] * len(b)
        longest = found[0][0]
        for n, i, j in found:
            if 2 * n < longest:
                break
            if used_a[i] or used_b[j] or used_a[i - n + 1] or used_b[j - n + 1] or any(used_a[i - n + 1 : i + 1]) or any(used_b[j - n + 1 : j + 1]):
                continue
            used_a[i - n + 1 : i + 1] = used_b[j - n + 1 : j + 1] = [True] * n
            covered += n
        # Tiles become marks that match nothing: numbers of their side.
        a = [-1 if u else w for w, u in zip(a, used_a, strict=True)]
        b = [-2 if u else w for w, u in zip(b, used_b, strict=True)]


PAIRED = {"(": ")", "[": "]", "{": "}", "“": "”", "«": "»", "「": "」", "『": "』", "„": "“", "（": "）", "【": "】"}
CLOSERS = set(PAIRED.values())
MARKUP = regex.compile(r"<(/?)([a-zA-Z][\w-]*)[^<>]*?(/?)>")
#: The signs that the parser stops at.
SIGN = regex.compile("```|[`\"<" + "".join(regex.escape(c) for c in (*PAIRED, *CLOSERS)) + "]")
VOID_TAGS = {"br", "hr", "img", "input", "meta", "link", "wbr"}


def left_open(text: str) -> list[str]:
    """What a pushdown parser still has on its stack at the end of the text.

    Fences and inline code hide what they hold; straight double quotes open at
    a word's beginning and close at its end; a closing sign pops what was opened
    last of its kind, and one without opening is ignored. A bracket that is part
    of a face, and a backtick within a word, open nothing.
    """
    stack: list[str] = []
    past = 0
    for m in SIGN.finditer(text):
        i, c = m.start(), m.group()
        if i < past:
            continue
        if c == "```":
            if not stack or stack[-1] != "`":
                if stack and stack[-1] == "```":
                    stack.pop()
                else:
                    stack.append("```")
                continue
            # Within inline code its first sign closes that.
            stack.pop()
            past = i + 1
            continue
        if stack and stack[-1] == "```":
            continue
        if c == "`":
            if stack and stack[-1] == "`":
                stack.pop()
            elif not (i and text[i - 1].isalnum()):
                stack.append("`")
        elif stack and stack[-1] == "`":
            continue
        elif c == '"':
            if '"' in stack:
                del stack[len(stack) - 1 - stack[::-1].index('"') :]
            elif not (i and text[i - 1].isalnum()) and i + 1 < len(text) and not text[i + 1].isspace():
                stack.append('"')
        elif c == "“" and stack and stack[-1] == "„":
            stack.pop()
        elif c in PAIRED:
            if not (c in "([{" and i and text[i - 1] in ":;=-"):
                stack.append(c)
        elif c in CLOSERS:
            for k in range(len(stack) - 1, -1, -1):
                if PAIRED.get(stack[k]) == c:
                    del stack[k:]
                    break
        elif tag := MARKUP.match(text, i):
            name = tag.group(2).lower()
            if tag.group(1):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k] == f"<{name}>":
                        del stack[k:]
                        break
            elif not tag.group(3) and name not in VOID_TAGS:
                stack.append(f"<{name}>")
            past = tag.end()
    return stack


def company(na: int, nb: int, both: int, total: int) -> float | None:
    """The information of two neighbours; None for words too rare to tell. Unknown neighbours count as far apart."""
    if na < 30 or nb < 30:
        return None
    return max(-2.0, min(3.0, math.log((both + 0.3) / (na * nb / total + 0.3))))


#: Neighbours that can tell shuffled words, and their least mean information in order.
TELLING, IN_ORDER = 6, 0.3


def breaks_off(w: str, seen: int, ends: int, starts: int, finals: int, known: int) -> bool:
    """Whether a text whose last word this is breaks off there.

    ``starts`` known words begin with the word, ``finals`` end on its last three letters.
    """
    if seen >= 30:
        return ends / seen < 0.03
    if w.isdigit():
        return False
    # A rare word: broken off if it begins known words and does not end as words do.
    if seen - ends <= 2 and starts and (len(w) <= 3 or ends == 0) and seen < 3:
        return True
    # Few words tell nothing about the endings of others.
    return known >= 1000 and seen == 0 and len(w) > 3 and finals <= 1


class Endings:
    """How words end sentences and texts in a corpus small enough to hold."""

    def __init__(self, words: Mapping[str, tuple[int, int]], pairs: Mapping[tuple[str, str], int] | None = None):
        self.words = words
        self.pairs = pairs or {}
        self.total = max(1, sum(n for n, _ in words.values()))
        self.cut: set[str] = set()
        finals: Counter[str] = Counter()
        starts: Counter[str] = Counter()
        for w in words:
            finals[w[-3:]] += 1
            for k in range(1, len(w)):
                starts[w[:k]] += 1
        self.starts, self.finals = starts, finals

    def in_order(self, words: list[str]) -> bool:
        """Whether adjacent words keep company as in the corpus, or have been shuffled.

        The mean information of neighbours, over words that are frequent enough
        to tell; unknown neighbours count as far apart.
        """
        w = [_lower(x) for x in words]
        n = [self.words.get(x, (0, 0))[0] for x in w]
        each = [company(n[i], n[i + 1], self.pairs.get((w[i], w[i + 1]), 0), self.total) for i in range(len(w) - 1)]
        found = [x for x in each if x is not None]
        return len(found) < TELLING or sum(found) / len(found) > IN_ORDER

    def broken(self, word: str) -> bool:
        """Whether a text whose last word this is breaks off there."""
        w = _lower(word)
        return breaks_off(w, *self.words.get(w, (0, 0)), self.starts[w], self.finals[w[-3:]], len(self.words))


def _lower(word: str) -> str:
    return word.lower().replace("’", "'")


SUBJECT = r"(?:i|we|this assistant|the (?:assistant|model)|this (?:model|system))"
NEGATED = (
    r"(?:can(?:not|'t| not)|could(?:n't| not)|won't|will not|wo n't|would(?:n't| not)|must (?:decline|refuse)|have to (?:decline|refuse)|(?:do not|don't|am not|'m not|are not|'re not) (?:able|comfortable|willing|allowed|permitted|going|in a position|feel comfortable|feel able)|(?:am|'m|are|'re) un(?:able|willing|comfortable)|(?:decline|refuse)|'d (?:rather|prefer) not|would (?:rather|prefer) not|will not be|won't be|(?:do not|don't) (?:feel comfortable|think i (?:can|should)))"
)
TASK = r"(?:rewrit|flip|mirror|generat|produc|creat|writ|provid|assist|help|compl|fulfil|do (?:that|this|so)|respond|translat|transform|convert|paraphras|continu|engag|process|answer|reproduc|invert|revers|output|shar(?:e|ing) (?:a|the) (?:mirror|rewrit|version)|craft|mak(?:e|ing) (?:a|the|this) (?:mirror|version|content)|support (?:this|the) request|offer)\w*"
THING = r"(?:(?:mirror|flip|rewritten|requested|this|that|such|the) ?(?:ed)? ?(?:text|version|post|content|request|task|message|output|response|statement|prompt)|content|request|version|rewrite|it|that|this|with)"
REFUSALS = [
    regex.compile(p, regex.I)
    for p in (
        rf"\b{SUBJECT}\s?(?:\w+ly )?{NEGATED}(?:\s\w+){{0,3}}?\s{TASK}(?:\W+(?:\w+\W+){{0,4}}?{THING}|\W*$|\W)",
        rf"\b(?:it )?(?:would|might) (?:not )?be (?:inappropriate|harmful|irresponsible|wrong|unethical|against [\w ]+|appropriate) (?:\w+ ){{0,3}}?to {TASK}",
        rf"\bno (?:mirror|flip|rewrit|revers|such|text|content|version)\w*(?: \w+)? (?:can|could|will|may) be {TASK}",
        rf"\b(?:this|that|it) is(?: not|n't) something (?:that )?{SUBJECT} (?:can|could|will|would|am able to|feel comfortable)\b",
        r"^\W*(?:(?:sorry|apologies|unfortunately)\W+)?(?:request (?:declined|denied|refused|rejected|blocked)|cannot comply|unable to comply|content (?:withheld|blocked|filtered|removed|policy)|i can(?:'t|not) do that|i won't do (?:that|this))\b[^.]{0,40}\W*$",
        r"^\W*(?:(?:sorry|apologies|unfortunately)\W+)?(?:refused|declined|no can do|no\W+sorry|sorry\W+no|no|i refuse|i decline|i must decline|i can(?:'t|not)|not possible|i'd rather not)\W*$",
        r"^\W*(?:refused|refusal|declined|denied|blocked)\s*[:\-]",
        r"\b(?:against|violat\w+|breach\w*|conflict\w* with) (?:my|our|the|its) (?:\w+ )?(?:guidelines|polic(?:y|ies)|rules|principles|values)\b",
        r"\bcontent (?:was |is |has been )?(?:withheld|blocked|filtered|removed) by (?:the )?(?:model|policy|filter|system|safety)",
        r"\bas an? (?:ai|artificial intelligence|language model|assistant)\b[^.]{0,40}\b(?:can't|cannot|can not|unable|not able|won't|will not|must decline|not something)\b",
        rf"\b(?:{SUBJECT} )?must (?:decline|refuse) to {TASK}",
        r"\b(?:lo siento|lo lamento|disculpa)\b[^.]{0,30}\bno (?:puedo|podemos|me es posible|voy a)\b|\bno puedo (?:reescribir|ayudar|generar|crear|cumplir|escribir|producir|hacer eso)",
        r"\b(?:désolée?|je regrette)\b[^.]{0,30}\bje ne (?:peux|puis)\b|\bje ne (?:peux|puis) pas (?:réécrire|aider|générer|créer|écrire|produire|faire cela)",
        r"\b(?:tut mir leid|leider)\b[^.]{0,40}\bkann ich\b[^.]{0,60}\bnicht\b|\bich kann (?:das|diesen|dabei|diese)\b[^.]{0,50}\bnicht\b[^.]{0,20}\b(?:umschreiben|helfen|erstellen|schreiben|erfüllen|generieren)",
        r"\b(?:desculp\w+|sinto muito|lamento)\b[^.]{0,30}\bnão (?:posso|podemos|consigo)\b|\bnão posso (?:reescrever|ajudar|gerar|criar|escrever|produzir|fazer isso)",
        r"\b(?:przepraszam|przykro mi)\b[^.]{0,30}\bnie mogę\b|\bnie mogę (?:przepisać|pomóc|wygenerować|stworzyć|napisać)",
        r"(?:извините|к сожалению|простите)[^.]{0,30}\bне могу\b|\bя не могу (?:переписать|помочь|создать|написать|выполнить)",
        r"申し訳(?:ありません|ございません)|お手伝いできません|書き換えることはできません|対応できません",
    )
]


#: What every refusal has somewhere.
HINT = regex.compile(
    r"can't|cannot|can not|could|won't|will not|wo n't|would|must|have to|do not|don't|am not|'m not|are not|'re not|\bun(?:able|willing|comfortable)|declin|refus|'d (?:rather|prefer)|might|\bno\b|is(?: not|n't) something|denied|blocked|rejected|withheld|filtered|removed|policy|not possible|against|violat|breach|conflict|no puedo|no podemos|posible|no voy|je ne|nicht|não|nie mogę|не могу|申し訳|できません|対応",
    regex.I,
)


def is_refusal(text: str) -> bool:
    """Whether the text declines the task."""
    head = " ".join(text.replace("’", "'").split())
    return HINT.search(head) is not None and any(p.search(head) for p in REFUSALS)


def without_marks(text: str) -> str:
    """The text without links and repost marks."""
    if "http" in text or "www." in text:
        text = LINK.sub(" ", text)
    return REPOST.sub(" ", text) if "@" in text else text


PICTURE = regex.compile(r"[\p{Extended_Pictographic}--[0-9#*©®™]]", regex.V1)


def is_empty(text: str | None) -> bool:
    if text is None:
        return True
    words = WORD.findall(text)
    if not words:
        return not PICTURE.search(text)
    return len(words) <= 4 and " ".join(words).casefold() in PLACEHOLDERS


def is_copy(original: str, response: str) -> bool:
    """Whether the response is the original, at most lightly changed."""
    strip = lambda t: [w.casefold().replace("’", "'") for w in WORD.findall(without_marks(t))]
    a, b = strip(original), strip(response)
    if not a or not b:
        return bool(original.strip()) and original.strip() == response.strip()
    if len(a) < 6:
        return a == b
    # Tiles cannot cover more than the words that both have.
    both = sum((Counter(a) & Counter(b)).values())
    if both < 0.75 * len(a) or both < 0.6 * len(b):
        return False
    n = tiled(a, b, 2)
    return n >= 0.75 * len(a) and n >= 0.6 * len(b)


#: Signs that cannot end a text.
OPEN_ENDS = set(",;:-–—(/&+=<“„«")


LIST_ITEM = regex.compile(r"\n\s*(?:[-*•]|\d+[.)])\s*$")
FACE = regex.compile(r"[:;]-?[-)(]$")


def unfinished(text: str) -> bool | list[str]:
    """Whether something is left open or a sign must go on; if only the last word can tell, the words that must be in order."""
    body = TAIL.sub("", text.rstrip())
    if not body:
        return False
    # What is open at the end was broken off within it.
    if left_open(body):
        return True
    last = body[-1]
    if last in OPEN_ENDS and not (last in "-–—" and body != text.rstrip()) and not FACE.search(body):
        return True
    if "\n" in text and LIST_ITEM.search(text.rstrip(" ")):
        return True
    core = body.rstrip("\"'”’»)]}*_ ")
    if not core or core[-1] in STOP or core != body.rstrip("'’*_ "):
        return False
    words = WORD.findall(core)
    if not words or not core.endswith(words[-1]):
        return False
    if len(words[-1]) == 1 and SCRIPTS["han"].match(words[-1]) is None and SCRIPTS["japanese"].match(words[-1]) is None and len(words) > 1 and len(words[-2]) == 1:
        return False  # spaced-out letters
    if any(SCRIPTS[s].match(words[-1]) for s in ("han", "japanese", "thai")):
        return words[-1:]
    return words


def is_truncated(text: str, endings: Endings) -> bool:
    """Whether the text breaks off: something left open, a sign that must go on, or a word that must."""
    found = unfinished(text)
    # The last word of shuffled words says nothing.
    return found if isinstance(found, bool) else endings.broken(found[-1]) and endings.in_order(found)


def other_language(source: str, text: str, profiles: Profiles | None) -> bool:
    """Whether the text is mainly in another language than the source."""
    if profiles is not None:
        return profiles.differ(without_marks(source), without_marks(text))
    a, b = language(source), language(text)
    return a is not None and b is not None and a != b


def settled(original: str | None, response: str | None, plain: Rewriter, profiles: Profiles | None = None) -> tuple[str | None, list[str] | None]:
    """The one defect of a pair if the pair alone tells it; else the words whose last one can still tell, or None."""
    text = None if response is None else plain(response)
    if is_empty(text):
        return "empty", None
    if is_refusal(text):
        return "refusal", None
    if original is not None:
        source = plain(original)
        if is_copy(source, text):
            return "copy", None
        if other_language(source, text, profiles):
            return "other_language", None
    found = unfinished(text)
    if isinstance(found, bool):
        return ("truncated" if found else None), None
    return None, [_lower(w) for w in found]


def defect(original: str | None, response: str | None, plain: Rewriter, endings: Endings) -> str | None:
    """The one defect of a pair, or None."""
    found, words = settled(original, response, plain)
    return "truncated" if words and endings.broken(words[-1]) and endings.in_order(words) else found


def learn_endings(df: DataFrame, columns: list[str], counts: Mapping[str, int], least: int = 2) -> DataFrame:
    """Counts of all words (w, empty v, n, e at a sentence's end) and neighbours (w, v, n) over all texts of the columns, staged.

    Those seen fewer than ``least`` times tell nothing and stay behind.
    """
    shared = Shared(df.sparkSession.sparkContext, dict(counts))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = rewriter_of(shared)
        seen: Counter[str] = Counter()
        ends: Counter[str] = Counter()
        beside: Counter[tuple[str, str]] = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                tokens = TOKEN.findall(plain(t).lower().replace("’", "'"))
                for a, b in zip(tokens, tokens[1:], strict=False):
                    if a[0].isalnum():
                        seen[a] += 1
                        if b[0] in STOP:
                            ends[a] += 1
                        elif b[0].isalnum():
                            beside[a, b] += 1
        if seen:
            keys = [*((w, "") for w in seen), *beside]
            n = [*seen.values(), *beside.values()]
            e = [*(ends[w] for w in seen), *([0] * len(beside))]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys]), pa.array(n, pa.int64()), pa.array(e, pa.int64())], names=["w", "v", "n", "e"])

    texts = df.select(F.explode(F.array_distinct(F.array(*columns))).alias("t")).where("t IS NOT NULL").mapInArrow(count, "w string, v string, n long, e long")
    return stage(texts.groupBy("w", "v").agg(F.sum("n").alias("n"), F.sum("e").alias("e")).where(F.col("n") >= least), "endings")


def broken_off(texts: DataFrame, counted: DataFrame) -> DataFrame:
    """The rows of ``texts`` (with columns row and words) that break off at their last word.

    ``counted`` comes from :func:`learn_endings`. All of it is joined, so nothing
    of the corpus is left out and nothing is held in one place.
    """
    known = counted.where("v = ''").select("w", "n", "e")
    size = known.agg(F.count("*").alias("known"), F.sum("n").alias("total")).first()
    n_known, total = size["known"], max(1, size["total"] or 0)
    texts = texts.withColumn("w", F.element_at("words", -1))
    asked = texts.select("w").distinct()
    begun = known.where("length(w) > 1").select(F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda k: F.substring("w", F.lit(1), k))).alias("w"))
    begun = begun.join(asked, "w", "left_semi").groupBy("w").agg(F.count("*").alias("starts"))
    finals = known.groupBy(F.expr("right(w, 3)").alias("final")).agg(F.count("*").alias("finals"))
    told = asked.withColumn("final", F.expr("right(w, 3)")).join(known, "w", "left").join(begun, "w", "left").join(finals, "final", "left").na.fill(0, ["n", "e", "starts", "finals"])

    @F.pandas_udf("boolean")
    def breaks(w: pd.Series, n: pd.Series, e: pd.Series, starts: pd.Series, finals: pd.Series) -> pd.Series:
        return pd.Series([breaks_off(*x, n_known) for x in zip(w, n, e, starts, finals, strict=True)], dtype=bool)

    @F.pandas_udf("double")
    def information(na: pd.Series, nb: pd.Series, both: pd.Series) -> pd.Series:
        return pd.Series([company(*x, total) for x in zip(na, nb, both, strict=True)], dtype=float)

    broken = stage(texts.join(told.where(breaks("w", "n", "e", "starts", "finals")).select("w"), "w", "left_semi"), "broken")
    beside = broken.where("size(words) > 1").select("row", F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda i: F.struct(F.element_at("words", i).alias("w"), F.element_at("words", i + 1).alias("v")))).alias("p")).select("row", "p.w", "p.v")
    frequent = known.where("n >= 30")
    met = beside.join(frequent.select("w", F.col("n").alias("na")), "w").join(frequent.select(F.col("w").alias("v"), F.col("n").alias("nb")), "v")
    met = met.join(counted.where("v != ''").select("w", "v", F.col("n").alias("both")), ["w", "v"], "left").na.fill(0, ["both"])
    # The last word of shuffled words says nothing.
    means = met.withColumn("i", information("na", "nb", "both")).groupBy("row").agg(F.count("i").alias("n"), F.avg("i").alias("i"))
    shuffled = means.where((F.col("n") >= TELLING) & (F.col("i") <= IN_ORDER))
    return broken.join(shuffled, "row", "left_anti")


def defects(df: DataFrame, key: str, original: str, response: str, labelled: tuple[DataFrame, str, str] | None = None) -> DataFrame:
    """``key`` and ``defect`` of every defective pair.

    ``labelled`` is a table with its text and language columns; the language
    profiles are learnt from all of it. Without it scripts and function words tell languages.

    A null response is empty; a null original cannot be copied and has no
    language. A null key stays null; repeated rows are judged one by one. An
    empty table gives no rows.
    """
    rows = df.select(F.col(key).alias("key"), F.col(original).alias("a"), F.col(response).alias("b"))
    counts = frequencies(rows.select(F.concat_ws(" ", "a", "b").alias("t")), "t")
    shared = Shared(df.sparkSession.sparkContext, dict(counts))

    profiled = None if labelled is None else Shared(df.sparkSession.sparkContext, learn(*labelled))

    @F.pandas_udf("defect string, words array<string>")
    def judge(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        plain = rewriter_of(shared)
        profiles = None if profiled is None else profiled.model("profiles", Profiles)
        return pd.DataFrame([settled(x, y, plain, profiles) for x, y in zip(a, b, strict=True)], columns=["defect", "words"], dtype=object)

    judged = rows.select("key", F.monotonically_increasing_id().alias("row"), judge("a", "b").alias("j")).select("key", "row", "j.defect", "j.words")
    judged = stage(judged.where("defect IS NOT NULL OR words IS NOT NULL"), "judged")
    cut = broken_off(judged.where("words IS NOT NULL"), learn_endings(rows, ["a", "b"], counts))
    found = judged.where("defect IS NOT NULL").select("key", "defect").unionByName(cut.select("key", F.lit("truncated").alias("defect")))
    return found.select(F.col("key").alias(key), "defect")
