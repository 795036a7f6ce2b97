"""Broken prompt and response pairs (problem 5): one defect per answer.

An answer goes through, in this order:

* ``empty``: NULL, or nothing left but blanks, invisible characters, punctuation, empty markup or a mark for
  "no output";
* ``refusal``: a sentence outside quotations that a *refusal grammar* accepts: an act of declining (in
  English: modal, inability, decision, impropriety) bound to the task (writing, request, character, ...); firm
  talk in character has the act without the task;
* ``copy``: *greedy string tiling* covers most words with runs of the persona, the rest being the prompt's;
* ``other_language``: mostly letters of another *script*, or unlike English by a letter n-gram model with a reject
  class (``english``), outside quotations, so any language in Latin letters is found;
* ``truncated``: a *pushdown parser* over fences, brackets, quotations, emphasis, markup tags and list items
  ends with something open, or the last sentence lacks its end.

Each row is judged by itself in one narrow map over two text columns; only defective rows leave it, and equal
results of repeated deliveries are merged afterwards. The word-set overlap computed before tiling is an upper
bound of the tiled share, so it only spares tilings that cannot succeed. The English model is fitted before, on
all personas, which are English, and all answers.

Refusal grammars: English, German, French, Spanish, Portuguese, Italian, Dutch, Swedish, Danish, Norwegian, Polish,
Turkish, Russian, Ukrainian, Chinese, Japanese, Korean and Arabic. A refusal in a language without one is
``other_language``.

Defined results: a NULL persona, group or sentiment can't be copied; repeated ``task_id`` give one row if their
defects agree, else the first in the order above; texts are judged whole, however long.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curaspark.llm.english import English, fit
from curaspark.llm.leakage import words_of
from curaspark.session import ship

DEFECTS = ["empty", "refusal", "copy", "other_language", "truncated"]
MIN_TILE = 3
COPY_SHARE = 0.6
OUTSIDE = 4

# Marks that stand for no output, letters and digits only.
NO_OUTPUT = set("na none null nil nan empty nooutput noresponse noanswer noreply undefined blank noresult nothing notavailable notapplicable emptyresponse nocontent notext tbd missing error".split())
# Words with which prompts introduce a persona, a group and a sentiment.
PROMPT_WORDS = set("persona profile character group sentiment prompt you are that s me my name i am user system role description target positive negative".split())

TASK = (
    r"(?:request|task|prompt|instructions?|assignment|(?:kind|sort|type) of (?:text|content|thing|piece)|text|passage|monologue|dialogue|speech|content|piece|essay|story|scene|paragraph|"
    r"character|persona|voice|role|profile|topic|question|query|response|answer|reply|statement|message)"
)
THIS = r"(?:this|that|these|such|the|your|what)"
DO = (
    r"(?:writ(?:e|ing)|generat(?:e|ing)|creat(?:e|ing)|produc(?:e|ing)|fulfil(?:l|ling)?|compl(?:y|ying)|assist(?:ing)?|answer(?:ing)?|respond(?:ing)?|reply(?:ing)?|voic(?:e|ing)|"
    r"compos(?:e|ing)|draft(?:ing)?|provid(?:e|ing)|help(?:ing)?|tak(?:e|ing) on|speak(?:ing)?|play(?:ing)?|portray(?:ing)?|continu(?:e|ing)|proceed(?:ing)?|engag(?:e|ing)|carry(?:ing)? out|"
    r"support(?:ing)?|adopt(?:ing)?|do(?:ing)?|complet(?:e|ing)|accept(?:ing)?|impersonat(?:e|ing)|deliver(?:ing)?)"
)
CANNOT = r"(?:can ?not|can't|could ?n[o']t|won't|will not|am unable to|am not able to|'m unable to|'m not able to|do not want to|don't want to|may not|must not|shall not|am not going to|'m not going to|unable to|not able to|not allowed to|not permitted to)"
WILL_NOT = r"(?:(?:must|have to|will|need to|would|'d|shall|'ll|should) (?:respectfully |politely |kindly |therefore |have to )*(?:decline|refuse|pass|refrain|abstain)|(?:would|'d) (?:rather|prefer) not|prefer not|(?:have )?(?:decided|chosen|choose|opted) not|decline|refuse|(?:am|'m) not (?:comfortable|willing|prepared|happy|ready)|(?:do not|don't) feel (?:comfortable|right|able)|wish not)"
# the refusal grammar: act of declining, then the task within the same sentence
ENGLISH_GRAMMAR = [
    rf"\bi (?:really |simply |just |truly |honestly |unfortunately )*{CANNOT} (?:be |ever |in good conscience |possibly |really )*{DO}\b[^.!?]{{0,40}}?\b{THIS}\b[^.!?]{{0,60}}?\b{TASK}\b",
    rf"\bi(?: am|'m)? ?(?:really |simply |just |unfortunately )*{CANNOT} (?:be |ever |in good conscience |possibly )*{DO}(?: with| to| on)? (?:this|that)(?: one| time)?\s*(?:[.!?,;]|$)",
    rf"\bi(?: am|'m)? ?(?:really |simply |just |unfortunately |also )*{WILL_NOT}\b[^.!?]{{0,40}}?\b{THIS}\b[^.!?]{{0,60}}?\b{TASK}\b",
    rf"\bi(?: am|'m)? ?(?:really |simply |just )*{WILL_NOT} (?:to |from |on )?(?:be )?(?:{DO})(?: in| with| to)?\s+(?:{THIS}\b[^.!?]{{0,40}}\b(?:{TASK}|one|way)\b|{TASK})",
    rf"\bi(?: am|'m)? ?(?:really |simply |just )*{WILL_NOT} (?:to |from |on )?(?:answer|respond|reply|comply|write|help|assist|continue)\w*(?:[.!?,;]|$| in the way| here| with (?:this|that))",
    rf"\b(?:wrong|inappropriate|irresponsible|unethical|improper|not right|not appropriate|harmful)(?: of| for)? (?:me|us)? ?to {DO}\b[^.!?]{{0,30}}?\b(?:{THIS}|a)\b[^.!?]{{0,40}}?\b{TASK}\b",
    rf"\b{THIS} {TASK}\b[^.!?]{{0,30}}?\b(?:is|falls|goes|lies|runs|would be|conflicts|violates)\b[^.!?]{{0,20}}?\b(?:outside|beyond|against|not something|contrary|with my|my (?:guidelines|policy|values))\b",
    r"\b(?:this|that) (?:is not|isn't|is no) (?:something|anything|a (?:thing|task|request)|one) (?:that )?i (?:can|could|will|would|am|'m|want|wish|feel)\b",
    rf"\bask you to (?:reconsider|rethink|change|rephrase|withdraw) (?:{THIS}) {TASK}\b",
    rf"\blet(?:'s| us) not (?:do|write|go|take|pursue|continue)\b[^.!?]{{0,20}}?\b(?:this|that|there)\b(?: one| {TASK})?\s*(?:[.!?]|$)",
    rf"\bthere (?:is|will be) no {TASK} from me\b",
    rf"\bas an? (?:ai|assistant|language model|ai (?:assistant|language model|model))\b[^.!?]{{0,60}}?\b(?:can ?not|can't|unable|decline|pass on|refuse|won't|not able|must not|may not|not allowed)\b",
    r"\bi(?:'m| am) sorry,? but i (?:can ?not|can't|won't|will not|am unable to|'m unable to)\s+(?:help|assist|comply|continue|do that|do this|answer|respond|fulfil)",
    rf"\b(?:pass|refuse to act|will not act) on (?:this|that|the|your) {TASK}\b",
    r"(?:^|[.!?;:]\s+|\bno,? |\bsorry,? (?:but )?)i(?:'m afraid i)? (?:really |simply |just )*(?:must|have to|will have to|'ll have to|need to)(?: respectfully| politely| kindly| therefore)* (?:decline|refuse)\s*(?:[.!?]|$)",
    rf"\bi (?:really |simply |just )*{CANNOT} (?:be |ever )*{DO}(?: with| to| on)? (?:this|that|it)(?: one)?(?: for (?:you|them|anyone)| here| today| at all)+\s*(?:[.!?,;]|$)",
]
OTHER_GRAMMAR = [
    # German
    r"\b(?:das|diesen?|dieser|diesem|dabei|damit|ihnen|solche[nrs]?)\b[^.!?]{0,40}\b(?:kann|möchte|werde|darf|will)\b[^.!?]{0,30}\bnicht\b[^.!?]{0,30}\b(?:schreiben|übernehmen|helfen|beantworten|verfassen|erstellen|erfüllen|machen|ausführen|bearbeiten)\b",
    r"\b(?:kann|möchte|werde|darf|will) ich\b[^.!?]{0,40}\bnicht\b[^.!?]{0,30}\b(?:schreiben|übernehmen|helfen|beantworten|verfassen|erstellen|erfüllen|ausführen|bearbeiten)\b",
    r"\bich (?:kann|möchte|werde|darf|will)\b[^.!?]{0,50}\bnicht\b[^.!?]{0,30}\b(?:schreiben|übernehmen|helfen|beantworten|verfassen|erstellen|erfüllen|ausführen|bearbeiten)\b",
    # French
    r"\bje (?:ne (?:peux|veux|vais|souhaite|puis|saurais|pourrai)(?: malheureusement)? pas|préfère ne pas|refuse d[e'’]|dois refuser)\b[^.!?]{0,20}\b(?:rédiger|répondre|écrire|aider|créer|produire|générer|traiter|accepter|satisfaire|accéder|donner suite|incarner)\b",
    # Spanish
    r"\b(?:no (?:puedo|voy a|quiero|deseo|podré|me es posible)|prefiero no|debo negarme a|me niego a)\b[^.!?]{0,20}\b(?:escribir|ayudar\w*|responder|crear|generar|redactar|cumplir|atender|producir|contestar)\b",
    # Portuguese
    r"\b(?:não (?:posso|vou|quero|consigo|poderei)|prefiro não|recuso-me a|devo recusar)\b[^.!?]{0,20}\b(?:escrever|ajudar|responder|criar|gerar|redigir|cumprir|atender|produzir)\b",
    # Italian
    r"\b(?:non (?:posso|voglio|riesco a|intendo|potrò)|preferisco non|mi rifiuto di|devo rifiutare)\b[^.!?]{0,20}\b(?:aiutar\w*|scrivere|rispondere|creare|generare|produrre|soddisfare|redigere)\b",
    # Dutch
    r"\b(?:kan|wil|mag|zal|ga) ik\b[^.!?]{0,40}\bniet\b[^.!?]{0,30}\b(?:schrijven|helpen|beantwoorden|maken|opstellen|uitvoeren|voldoen)\b",
    r"\bik (?:kan|wil|mag|zal|ga)\b[^.!?]{0,40}\bniet\b[^.!?]{0,30}\b(?:schrijven|helpen|beantwoorden|maken|opstellen|uitvoeren|voldoen)\b",
    # Swedish, Danish, Norwegian
    r"\b(?:jag|jeg) (?:kan|vill|vil|får|får|kommer)\b[^.!?]{0,20}\b(?:inte|ikke)\b[^.!?]{0,30}\b(?:skriva|skrive|hjälpa|hjelpe|hjælpe|svara|svare|skapa)\b",
    r"\b(?:kan|vill|vil) (?:jag|jeg)\b[^.!?]{0,20}\b(?:inte|ikke)\b[^.!?]{0,30}\b(?:skriva|skrive|hjälpa|hjelpe|hjælpe|svara|svare|skapa)\b",
    # Polish
    r"\bnie (?:mogę|chcę|będę|potrafię)\b[^.!?]{0,30}\b(?:napisać|pisać|pomóc|odpowiedzieć|spełnić|stworzyć)\b",
    # Turkish
    r"\b(?:yazamam|yazmayacağım|yardımcı olamam|yardım edemem|cevaplayamam|yanıtlayamam|oluşturamam|yerine getiremem)\b",
    # Russian, Ukrainian
    r"\b(?:не (?:могу|буду|хочу|можу|хочу)|отказываюсь|відмовляюся)\b[^.!?]{0,30}\b(?:написать|писать|помочь|ответить|отвечать|выполнить|создать|написати|писати|допомогти|відповісти|виконати)\b",
    # Chinese, Japanese, Korean
    r"(?:无法|無法|不能|不便|不会|不會|拒绝|拒絕)[^。！？]{0,12}(?:写|寫|协助|協助|帮助|幫助|提供|满足|滿足|回答|创作|創作|生成|完成)",
    r"(?:書|手伝|答え|対応|作成|お受け)[^。！？]{0,10}(?:できません|できかねます|いたしかねます|しかねます|けません)",
    r"(?:작성|도와|도움|답변|제공|써)[^.!?]{0,12}(?:수 없|수는 없|않겠)",
    # Arabic
    r"(?:لا يمكنني|لا أستطيع|لن أستطيع|أعتذر عن|أرفض)[^.!؟]{0,25}(?:كتابة|أكتب|مساعد|الإجابة|تلبية|إنشاء)",
]

# Literals of which a sentence must hold one to be accepted by the pattern of the same position; they only spare searches.
_CANNOT = ("can not", "cannot", "can't", "could", "won't", "will not", "able to", "want to", "may not", "must not", "shall not", "going to", "not allowed", "not permitted")
_WILL_NOT = ("declin", "refus", "pass", "refrain", "abstain", "rather not", "prefer", "decided not", "chosen not", "choose not", "opted not", "not comfortable", "not willing", "not prepared", "not happy", "not ready", "feel comfortable", "feel right", "feel able", "wish not")
_NOT = ("niet", "inte", "ikke", "nie ", "nicht", "pas ", "refuse", "refuser", " no ", "no ", "prefiero", "negarme", "niego", "não", "prefiro", "recus", "non ", "preferisco", "rifiut")
ANCHORS = [
    _CANNOT, _CANNOT, _WILL_NOT, _WILL_NOT, _WILL_NOT,
    ("wrong", "inappropriate", "irresponsible", "unethical", "improper", "not right", "not appropriate", "harmful"),
    ("outside", "beyond", "against", "not something", "contrary", "with my", "my guidelines", "my policy", "my values"),
    ("isn't", "is not", "is no "), ("ask you to",), ("let's not", "let us not"), ("from me",), ("as an ai", "as an assistant", "as a language", "as an language", "as a "), ("sorry",), ("pass on", "refuse to act", "not act"),
    ("declin", "refuse"), _CANNOT,
    *[_NOT] * 12, *[None] * (len(OTHER_GRAMMAR) - 12),
]
REFUSAL: dict[tuple[str, ...] | None, list[re.Pattern]] = {}  # patterns of the same literals together, which are looked for once
for _anchors, _pattern in zip(ANCHORS, ENGLISH_GRAMMAR + OTHER_GRAMMAR, strict=True):
    REFUSAL.setdefault(_anchors, []).append(re.compile(_pattern))

THINK = re.compile(r"<think>.*?</think>|</?think>", re.S | re.I)
TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
QUOTED = re.compile(r"\"[^\"]*\"|“[^”]*”|«[^»]*»|„[^“”]*[“”]")
ENVELOPE = "*_\"“”«»„ \t\r\n\u200b\ufeff "
ALNUM = re.compile(r"[^\W_]+")
MARKS = re.compile(r"```|\*\*|[()\[\]{}“”«»„\"*\n]|</?[a-zA-Z][^<>]*>")
MARK_CHARS = set("`*()[]{}“”«»„\"<")
LIST_ITEM = re.compile(r"[ \t]*(?:[-*•+]|\d+[.)])[ \t]+")
STAGE_END = re.compile(r"(?:\([^()]*\)|\[[^\[\]]*\]|(?<![*\w])\*[^*\n]+\*(?!\*)|</?[a-zA-Z][^<>]*>)$")
CLOSE = {"(": ")", "[": "]", "{": "}", "“": "”", "«": "»", "„": "“"}
ENDS = set(".!?…。！？")
CLOSERS = set("\"”»“’'*_`)]}>~ ")


def is_empty(text: str | None) -> bool:
    """Nothing but blanks, invisible characters, punctuation, symbols, empty markup or a mark for no output."""
    if text is None:
        return True
    if "think>" in text:
        text = THINK.sub("", text)
    letters = (c for c in unicodedata.normalize("NFKC", TAG.sub("", text)) if c.isalnum())
    left = "".join(islice(letters, 40)).lower()  # longer than every mark
    return not left or left in NO_OUTPUT


def is_refusal(text: str) -> bool:
    """Some sentence outside quotations is accepted by the refusal grammar."""
    lowered = text.lower()
    for mark in "’‘´`":
        lowered = lowered.replace(mark, "'")
    body = None
    plain = lowered.isascii()
    for anchors, patterns in REFUSAL.items():
        if (anchors is None and not plain) or (anchors is not None and any(map(lowered.__contains__, anchors))):
            if body is None:
                body = QUOTED.sub(" ", lowered.strip(ENVELOPE)).replace("\n", " ")
            if any(x.search(body) for x in patterns):
                return True
    return False


def tiled_words(text: list[str], source: list[str], least: int = MIN_TILE) -> int:
    """Words of ``text`` covered by greedy string tiling with ``source``: longest common runs first, none overlapping."""
    starts = defaultdict(list)
    for j in range(len(source) - least + 1):
        starts[tuple(source[j : j + least])].append(j)
    heap: list[tuple[int, int, int]] = []
    for i in range(len(text) - least + 1):
        for j in starts.get(tuple(text[i : i + least]), ()):
            if i and j and text[i - 1] == source[j - 1]:
                continue
            n = least
            while i + n < len(text) and j + n < len(source) and text[i + n] == source[j + n]:
                n += 1
            heapq.heappush(heap, (-n, i, j))
    used_text, used_source, covered = bytearray(len(text)), bytearray(len(source)), 0
    while heap:
        n, i, j = heapq.heappop(heap)
        n = -n
        free, run = [], 0
        for k in range(n + 1):
            if k < n and not used_text[i + k] and not used_source[j + k]:
                run += 1
            else:
                if run >= least:
                    free.append((k - run, run))
                run = 0
        if free == [(0, n)]:
            used_text[i : i + n] = used_source[j : j + n] = b"\x01" * n
            covered += n
        else:
            for at, run in free:
                heapq.heappush(heap, (-run, i + at, j + at))
    return covered


@lru_cache(maxsize=4096)
def _source(persona: str | None) -> tuple[list[str], frozenset[str]]:
    words = words_of(persona)
    return words, frozenset(words)


@lru_cache(maxsize=4096)
def _prompt(group: str | None, sentiment: str | None) -> frozenset[str]:
    return frozenset(PROMPT_WORDS.union(words_of(group), words_of(sentiment)))


def is_copy(words: list[str], distinct: frozenset[str], persona: str | None, group: str | None, sentiment: str | None) -> bool:
    """Little or nothing beyond the words of the persona and the prompt."""
    if not words:
        return False
    source, own = _source(persona)
    prompt = _prompt(group, sentiment)
    if len(distinct - own - prompt) > (1 - COPY_SHARE) * len(words):
        return False
    rest = sum(map(prompt.__contains__, words))
    if sum(map(own.__contains__, words)) + rest < COPY_SHARE * len(words):
        return False
    if rest >= 0.9 * len(words):
        return True
    covered = tiled_words(words, source)
    return covered + min(rest, len(words) // 4 if covered else 0) >= COPY_SHARE * len(words) and covered >= 0.4 * len(words)


def is_other_language(text: str, english: English | None) -> bool:
    """Another script or unlike English, outside quotations if there is enough outside."""
    body = text.strip(ENVELOPE)
    if QUOTED.search(body):
        outside = QUOTED.sub(" ", body)
        body = outside if len(ALNUM.findall(outside)) >= OUTSIDE else body
    if not body.isascii():
        letters = [c for c in body if c.isalpha()]
        if sum(ord(c) > 0x24F and not unicodedata.name(c, "").startswith(("LATIN", "MATHEMATICAL", "FULLWIDTH LATIN", "MODIFIER")) for c in letters) > 0.5 * len(letters):
            return True
    return english is not None and english.rejects_text(body)


def open_constructs(text: str) -> list[str]:
    """What a pushdown parser over fences, brackets, quotations, emphasis and tags has left open at the end."""
    stack: list[str] = []
    for m in MARKS.finditer(text):
        mark = m[0]
        top = stack[-1] if stack else ""
        if top == "```":
            if mark == "```":
                stack.pop()
        elif mark == "\n":
            if top in ("*", "**"):
                stack.pop()  # emphasis ends with its line
        elif mark in ("```", '"', "**"):
            if mark in stack and mark != "```":
                while stack.pop() != mark:  # closes what is inside, too
                    pass
            else:
                stack.append(mark)
        elif mark == "*":
            start = text.rfind("\n", 0, m.start()) + 1
            bullet = LIST_ITEM.match(text, start)
            if top == "*":
                stack.pop()
            elif not (bullet and start <= m.start() < bullet.end()) and m.end() < len(text) and not text[m.end()].isspace():
                stack.append("*")
        elif mark[0] == "<":
            name = mark.strip("</>").split()[0].split("/")[0].lower() if mark.strip("</> ") else ""
            if mark[1] == "/":
                if f"<{name}" in stack:
                    while stack.pop() != f"<{name}":
                        pass
            elif name not in ("br", "hr", "img", "p", "li") and not mark.endswith("/>"):
                stack.append(f"<{name}")
        elif top and CLOSE.get(top) == mark:
            stack.pop()
        elif mark in CLOSE and not (mark == "“" and "„" in stack):
            stack.append(mark)
        elif any(CLOSE.get(x) == mark for x in stack):
            while CLOSE.get(stack.pop()) != mark:
                pass
    return stack


def is_truncated(text: str) -> bool:
    """Something stays open, or the last sentence has no end."""
    body = text.rstrip()
    while body:
        last = body[-1]
        if last in ENDS:
            break
        if last.isspace() or last in CLOSERS or unicodedata.category(last) in ("So", "Sk", "Cf", "Mn", "Cs", "Co", "Cn"):
            stage = STAGE_END.search(body)
            body = body[: stage.start()].rstrip() if stage and stage.start() > 0 else body[:-1].rstrip()
            continue
        line = body[body.rfind("\n") + 1 :]
        lines = [x for x in body.split("\n") if LIST_ITEM.match(x)]
        if LIST_ITEM.match(line) and len(lines) > 2 and last.isalnum() and not any(x.rstrip()[-1:] in ENDS for x in lines[:-1]):
            break  # items of this list have no full stops
        return True
    if MARK_CHARS.isdisjoint(text):
        return False
    return any(x not in ("*", "**") for x in open_constructs(text))


def defect_of(text: str | None, persona: str | None, group: str | None, sentiment: str | None, english: English | None = None) -> str | None:
    """The first defect that fits, else None. Without an English model only other scripts are another language."""
    if is_empty(text):
        return "empty"
    if "think>" in text:
        text = THINK.sub(" ", text)
    words = words_of(text)
    if is_refusal(text):
        return "refusal"
    if is_copy(words, frozenset(words), persona, group, sentiment):
        return "copy"
    if is_other_language(text, english):
        return "other_language"
    return "truncated" if is_truncated(text) else None


def defects(pairs: DataFrame, english: English | None = None) -> DataFrame:
    """``task_id, defect`` of the defective answers; ``english`` is fitted on all pairs if it isn't given."""
    ship(pairs.sparkSession)
    shared = pairs.sparkSession.sparkContext.broadcast(fit(pairs, "persona", "text") if english is None else english)  # FEATURES numbers
    kind = pairs.schema["task_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [defect_of(*row, shared.value) for row in zip(*(batch.column(k).to_pylist() for k in range(1, 5)))]
            at = [k for k, d in enumerate(found) if d]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, type=pa.int64())), pa.array([DEFECTS.index(found[k]) for k in at], type=pa.int32())], names=["task_id", "defect"])

    ranked = pairs.select("task_id", "text", "persona", "group", "sentiment").mapInArrow(run, f"task_id {kind}, defect int")
    first = ranked.groupBy("task_id").agg(F.min("defect").alias("defect"))
    names = F.array(*[F.lit(d) for d in DEFECTS])
    return first.select("task_id", names[F.col("defect")].alias("defect"))
