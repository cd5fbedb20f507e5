"""Question-answer pairs that are no use: empty, truncated, refusing, copying or foreign answers."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.consistent_text import consistent_array
from factloom.llm.endings import open_parts, sentence_end, strip_residue
from factloom.llm.languages import _LISTS, foreign, languages, other_profile, other_script
from factloom.llm.tiling import greedy_tiles

# Stand-ins for a missing value, without case and outer punctuation.
STAND_INS = frozenset(
    "null|none|nil|na|n/a|n.a|n. a|nan|undefined|unknown|missing|empty|blank|tbd|tba|todo|no answer|not available|not applicable|no data|no response|leer|keine angabe|k.a|k. a|vide|néant|aucune réponse|s/o|vacío|sin respuesta|sin datos".split("|")
)

#: The longest lead-in before a repeated question, in words.
LEAD_WORDS = 6

# The refusal grammar: a softening lead, a refusing clause with its subject, then excuses or advice.
_G = {
    "self": r"(?:i|we|this (?:system|assistant|model|service)|the (?:system|assistant|model))",
    "cannot": r"(?:can ?not|can'?t|could ?n[o']t|am not able to|are not able to|am unable to|are unable to|is unable to|is not able to|must not|may not|am not (?:permitted|allowed|authorized|authorised) to|won'?t|will not|would rather not|'?d rather not|'?d prefer not to|prefer not to|do not wish to|don'?t wish to)",
    "say": r"(?:answer|comment|reply|respond|help|assist|discuss|provide|share|give|say|tell|disclose|address|comply|speculate|offer|support|fulfil+|engage|talk|continue|complete|process|confirm|advise)",
}
_REFUSALS = {
    "en": [
        r"\b{self}(?:'m|'re)? ?(?:really |simply |just |also )?{cannot} (?:be able to )?(?:\w+ ){{0,2}}{say}",
        r"\bi'?m (?:not able|unable) to (?:\w+ ){{0,2}}{say}",
        r"\b{self} (?:must|have to|need to|will) (?:respectfully |politely )?(?:decline|refuse|pass|abstain|refrain)",
        r"\b{self} (?:respectfully |politely )?(?:decline|refuse) (?:to|the)",
        r"\b{self} (?:do not|don'?t) have (?:enough|sufficient|the necessary|any|access)(?: \w+){{0,4}} (?:information|knowledge|data|context|to)",
        r"\b(?:it is|it's|this is|that is|that's) (?:\w+ ){{0,2}}(?:beyond|outside|against|not something|something) (?:\w+ ){{0,4}}(?:permitted|allowed|able|scope|abilities|ability|capabilities|policy|guidelines|discuss|won't|cannot|can't|comment|answer)",
        r"\bmy (?:guidelines|rules|policies|policy|instructions|programming|training)(?: \w+){{0,2}} (?:prevent|forbid|prohibit|do not|don't|does not|keep|stop)",
        r"\bno (?:answer|reply|response|statement|comment) (?:can|could|will|may) be (?:given|provided|made)",
        r"\b(?:passages?|context|documents?|sources?|texts?|information) (?:provided |given )?(?:do|does|did) not (?:allow|permit|enable|let) (?:me|us)",
        r"\b(?:the answer|an answer) (?:is not available|cannot be (?:given|provided|determined))",
        r"\b(?:not able|unable) to (?:answer|help|assist|comment|provide|respond)",
        r"\b(?:question|request|topic|subject|this|that) (?:falls|lies|is|goes) (?:well )?(?:outside|beyond) (?:of )?(?:what (?:i|we) (?:can|do|am|are|could|may)|my|our|the scope)",
    ],
    "fr": [
        r"\bje (?:ne|n')? ?(?:peux|puis|suis|saurais|veux|souhaite|dispose)(?: pas)?(?: \w+){{0,3}} (?:répondre|aider|fournir|commenter|donner|prononcer|discuter|autorisée?|mesure|informations?)",
        r"\bje préfère ne pas\b", r"\bje (?:refuse|dois refuser|dois décliner|décline)\b", r"\bimpossible (?:pour moi )?de (?:répondre|vous)", r"\bil m'est impossible\b", r"\bje n'ai pas (?:assez|suffisamment|le droit|accès)", r"\bne (?:me|nous) permet(?:tent)? pas de (?:répondre|vous)", r"\baucune réponse ne peut",
    ],
    "de": [
        r"\bich (?:kann|darf|möchte|will|werde|muss)(?: \w+){{0,6}} (?:nicht|keine|kein|ablehnen|verweigern)\b", r"\bmöchte ich (?:mich )?(?:\w+ ){{0,3}}(?:nicht|keine)", r"\bkann ich (?:\w+ ){{0,4}}(?:nicht|keine|leider)", r"\bdarf ich (?:\w+ ){{0,4}}(?:nicht|keine)", r"\bes ist mir (?:leider )?nicht (?:möglich|gestattet|erlaubt)", r"\bich bin nicht (?:in der lage|befugt|berechtigt)", r"\bkeine antwort (?:geben|möglich|gegeben)", r"\berlauben (?:es )?mir (?:\w+ )?nicht",
    ],
    "es": [
        r"\bno (?:me|nos) (?:es posible|permiten?|está permitido|corresponde)\b", r"\bno (?:puedo|podemos|quiero|debo|deseo|estoy autorizad[oa]|tengo (?:suficiente|permitido|acceso|la información))\b", r"\bprefiero no\b", r"\bdebo (?:rechazar|declinar|abstenerme|negarme)", r"\bme niego a\b", r"\bno se puede dar (?:una |ninguna )?respuesta", r"\bno (?:me )?permiten? responder",
    ],
}
_REFUSAL = re.compile("|".join(p.format(**_G) for group in _REFUSALS.values() for p in group))
# What goes with a refusal without answering: excuses, advice, offers; and what turns a refusing sentence round.
_TALK = re.compile(
    r"\b(?:sorry|apolog\w+|unfortunately|regret\w*|please|try|consult|contact|ask|refer to|check|visit|look up|recommend|suggest|advise|would you|do you|can i|could you|may i|let me know|feel free|happy to|glad to|thank|if you|you (?:can|could|may|might|should|will|would|need|want)|your|anything else|instead|as an? (?:ai|assistant|language model|large language model)|language model"
    r"|désolée?|malheureusement|regrette\w*|veuillez|essayez|consulte[rz]|contactez|adressez|vérifiez|demandez|souhaitez|pouvez|pourriez|vous|votre|merci|n'hésitez"
    r"|leider|bedau[re]\w*|bitte|tut mir|versuchen sie|wenden sie|fragen sie|konsultieren|prüfen sie|möchten sie|können sie|gibt es sonst|ihnen|ihre[rnms]?|danke"
    r"|siento|lament\w+|por favor|disculp\w+|perdón|intente|consulte|pregunte|póngase|contacte|verifique|puede|podría|desea|le recomiendo|gracias|su pregunta)\b"
)
_TURN = re.compile(r"\b(?:but|however|though|aber|jedoch|mais|cependant|pero|sino)\b")
#: The share of a question's letters that a copy may lack.
COPIED = 0.15
_FUNCTION = frozenset().union(*_LISTS.values())
_BREAK = re.compile(r"\s*[^\w\s]")  # what parts a lead-in from the question
_APART = re.compile(r"[\W_]+")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def _letters(text: str) -> str:
    return _APART.sub("", text.casefold())


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    core = _EDGE.sub("", answer.casefold())
    return not core or core in STAND_INS or " ".join(core.split()) in STAND_INS


def copies_question(question: str, answer: str) -> bool:
    """The answer is the question again: tiles of its letters, in order, cover question and answer.

    The tiles must hold the word that asks and all but COPIED of the question's letters; the answer may have a short
    lead-in before them, parted by a mark, and no more than the same share of other letters between or after them.
    A question turned into its answer loses the asking word or its order, and is no copy.
    """
    q, a = _letters(question), _letters(answer)
    asking = re.search(r"[^\W_]+", question)
    if not q or len(a) < (1 - COPIED) * len(q) or _letters(asking[0]) not in a:
        return False
    slack, least = int(COPIED * len(q)), min(4, len(q))
    there = {a[i : i + least] for i in range(len(a) - least + 1)}
    starts = [i for i in range(len(q) - least + 1) if q[i : i + least] in there]
    if sum(min(y - x, least) for x, y in zip(starts, [*starts[1:], len(q)])) < len(q) - slack:
        return False  # no tiles can cover more than these runs do
    tiles = sorted(greedy_tiles(q, a, least))
    if sum(t[2] for t in tiles) < len(q) - slack or tiles[0][0] > 0 or tiles[0][2] < min(len(_letters(asking[0])), len(q)):
        return False
    if any(y[1] < x[1] for x, y in zip(tiles, tiles[1:])):
        return False
    begin, end = tiles[0][1], tiles[-1][1] + tiles[-1][2]
    if len(a) - end > min(slack, 3) or end - begin - sum(t[2] for t in tiles) > slack:
        return False
    lead, letters, at = 0, 0, 0
    for word in re.finditer(r"[^\W_]+", answer):
        if letters >= begin:
            break
        letters += len(_letters(word[0]))
        lead, at = lead + 1, word.end()
    return lead == 0 or lead <= LEAD_WORDS and _BREAK.match(answer[at:]) is not None


def _news(sentence: str, question: str) -> bool:
    """Whether a sentence says something: a number or a name that the question does not have.

    A name is a word with a capital inside the sentence, in German two of them in a row; in a text without capitals any
    sentence of three words or more counts.
    """
    if any(n not in question for n in re.findall(r"\d+", sentence)):
        return True
    listed = re.findall(r"[^\W\d_]+", sentence)
    if not any(w[0].isupper() for w in listed):
        return len(listed) >= 3
    names = [i > 0 and len(w) > 1 and w[0].isupper() and w.casefold() not in question for i, w in enumerate(listed)]
    return any(x and y for x, y in zip(names, names[1:])) or any(names) and languages(sentence) != ["de"]


def refuses(question: str, answer: str) -> bool:
    """Some sentence declines, and no other one answers: each is an excuse, advice or an offer, or says nothing new."""
    q, refused = question.casefold(), False
    for sentence in re.split(r"(?<=[.!?])\s+", " ".join(answer.replace("’", "'").split())):
        plain = sentence.casefold()
        if found := _REFUSAL.search(plain):
            refused = True
            turn = _TURN.search(plain, found.end())
            if turn and _news(sentence[turn.end() :], q):
                return False
        elif not _TALK.search(plain) and _news(sentence, q):
            return False
    return refused


def truncated(answer: str) -> bool:
    """Breaks off before its sentence ends. Bare names, numbers and places are whole answers."""
    core, residue = strip_residue(answer)
    if not core:
        return False
    if residue:
        return True
    whole = sentence_end(core)
    if whole:
        return bool(open_parts(core))
    if core[-1] == "." or open_parts(core):
        return True
    words = re.findall(r"[^\W\d_]+", core)
    if not words:
        return False
    lower = [w for w in words if w[0].islower()]
    if not lower:
        return False
    if len(lower) == len(words) and len(words) <= 4:  # a name or place in small letters
        return any(w in _FUNCTION for w in words)
    return any(w in _FUNCTION or len(w) > 3 for w in lower)


def defect(question: str, answer: str | None) -> str | None:
    """The defect of an answer in its consistent form, or None."""
    if is_empty(answer):
        return "empty"
    if copies_question(question, answer):
        return "copies_question"
    if refuses(question, answer):
        return "refusal"
    if other_script(question, answer) or foreign(question, answer) or other_profile(question, answer):
        return "other_language"
    return "truncated" if truncated(answer) else None


def _flag(fields: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            questions = consistent_array(batch.column(1))[0].to_pylist()
            keys = batch.column(0).to_pylist()
            rows: list[tuple[int, str, str]] = []
            for i, field in enumerate(fields):
                answers = consistent_array(batch.column(2 + i))[0].to_pylist()
                rows += [(k, field, d) for k, q, a in zip(keys, questions, answers) if (d := defect(q, a))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows]) for i in range(3)], names=["row_id", "field", "defect"])

    return flag


def broken_pairs(df: DataFrame, row_id: str, question: str, answers: Sequence[str]) -> DataFrame:
    """(row_id, field, defect): one row for each defective answer; defects as in the module's functions.

    Rows with a null or empty question take no part; a null answer is empty. An answer has one defect, the first of
    empty, copies_question, refusal, other_language, truncated. Empty tables give an empty result; repeated rows are
    judged each; other columns are not read. One scan, no shuffle.
    """
    narrow = df.select(F.col(row_id).cast("long").alias("k"), F.col(question).alias("q"), *[F.col(a).alias(f"a{i}") for i, a in enumerate(answers)]).where("q <> ''")
    return narrow.mapInArrow(_flag(answers), "row_id long, field string, defect string")
