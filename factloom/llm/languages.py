"""Language of short texts: scripts, character trigrams, and function words where a text is too short for them."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from functools import cache, lru_cache

import numpy as np

# Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the of and to in is was were are be been that this these those it its he she they his her their with for from by on at as an a or but not no who which what when where how why there has have had will would can could into after before under over than then so such only all both many some any each other about between during through against because if while although also does do did doesn't don't isn't wasn't called made my your our its them him me us most more less few every here again once how's",
    "fr": "le la les l un une des du de d et à au aux en dans par pour sur sous avec sans est sont était fut a ont été il elle ils elles ce cet cette ces c qui que qu quoi dont où ne pas plus se s sa son ses leur leurs nous vous je y comme mais ou donc car quand chaque tout toute tous après avant depuis vers chez entre lors selon deux ans fait être non loin même aussi très peu quel quelle quels quelles combien t trouve leurs cela ceux celle celui alors encore jamais toujours rien été malgré trop",
    "de": "der die das den dem des ein eine einen einem einer eines und oder aber nicht kein keine ist sind war waren wurde wurden wird werden hat haben hatte hatten sein seine seiner ihr ihre es er sie wir ich in im an am auf aus bei mit nach von vom zu zum zur für über unter vor zwischen durch gegen um als wie wenn dass daß weil auch noch nur schon sehr mehr so man sich ihm ihn ihnen diese dieser dieses jahr gibt welche welcher welches wo wer was wann damals sowie insgesamt welchem welchen wem wen wessen woher wohin viele vielen steht liegt befindet stammt trotz nahe beim ins ans da dort hier dann doch einige einigen jede jeder jedes alle allen ihrem ihren ihrer seinem seinen kann möchte leider lange",
    "es": "el la los las un una unos unas de del al y o u pero no ni en por para con sin sobre entre desde hasta hacia según es son era eran fue fueron ser ha han había hay se su sus le les lo que quien quién cual cuál cuando cuándo donde dónde como cómo más muy ya también este esta estos estas ese esa aquel cada todo toda todos tras durante año años está están tiene tuvo pese lejos cuántos cuántas cuánto quiénes cuáles encuentra ella ellos ellas nos nosotros aquí allí menos poco mucho muchos nunca siempre antes después mismo misma",
    "it": "il lo la i gli le un uno una di del della dei delle dello da dal dalla in nel nella con su sul sulla per tra fra e o ma non è sono era erano fu furono ha hanno aveva si che chi cui quando dove come più anche questo questa questi quella ogni tutto tutti dopo prima durante anno anni c'è",
    "pt": "o a os as um uma de do da dos das em no na nos nas por pelo pela para com sem sobre entre e ou mas não é são era foi foram ser há tem têm tinha se que quem qual quando onde como mais também este esta isso cada todo todos após antes durante ano anos",
    "nl": "de het een en of maar niet geen is zijn was waren werd werden wordt heeft hebben had in op aan uit bij met naar van voor door over onder tussen tegen om als die dat deze dit er hij zij ze wij ik ook nog maar zeer meer jaar wie wat waar wanneer hoe",
}
_LISTS = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
# Letters and marks that one of the languages does not share with English.
_LETTERS = {"es": "¿¡", "de": "ß"}
_WORD = re.compile(r"[^\W\d_]+")


def evidence(text: str) -> dict[str, set[str]]:
    """The function words of each language that occur in text, names (capitalised inside a sentence) included."""
    found = set(_WORD.findall(text.lower()))
    hits = {k: found & v for k, v in _LISTS.items()}
    for k, marks in _LETTERS.items():
        hits[k] = hits[k] | {m for m in marks if m in text}
    return hits


@lru_cache(256)
def languages(text: str) -> list[str]:
    """The languages that explain most function words; several if they explain as many, none without evidence."""
    hits = evidence(text)
    most = max(len(x) for x in hits.values())
    return [k for k, x in hits.items() if len(x) == most] if most else []


def foreign(question: str, answer: str) -> bool:
    """Whether the whole answer is in another language than the question.

    It is if, for each language the question may be in, some other language explains at least two function words of
    the answer that the question's lacks, and more than three times as many as only the question's explains. One word
    is enough in a sentence (three words in small letters) of which only the question's language explains none.
    """
    hits = evidence(answer)
    least = 1 if sum(w.islower() for w in _WORD.findall(answer)) >= 3 else 2

    def beaten(asked: str) -> bool:
        own = hits[asked]
        return any(len(x - own) >= (least if x >= own else 2) and len(x - own) > 3 * len(own - x) for k, x in hits.items() if k != asked)

    asked = languages(question)
    return bool(asked) and all(map(beaten, asked))


@cache
def _script(c: str) -> str:
    """A letter's script: the first word of its name; the kana are one."""
    name = unicodedata.name(c, "").split(" ", 1)[0].split("-")[0]
    return {"HIRAGANA": "KANA", "KATAKANA": "KANA", "HALFWIDTH": "KANA", "FULLWIDTH": "LATIN", "FEMININE": "LATIN", "MASCULINE": "LATIN"}.get(name, name)


def script_of(text: str) -> str | None:
    """The script of most letters (LATIN, CYRILLIC, CJK, ...), None without letters. CJK with some kana is KANA."""
    counts = Counter(map(_script, filter(str.isalpha, text)))
    if not counts:
        return None
    most = max(counts, key=lambda k: (counts[k], k))
    return "KANA" if most == "CJK" and 10 * counts["KANA"] >= counts["CJK"] + counts["KANA"] else most


def other_script(question: str, answer: str) -> bool:
    """Whether the answer is in another script than the question; CJK alone may answer a Japanese question."""
    asked, said = script_of(question), script_of(answer)
    return bool(asked and said and asked != said and (asked, said) != ("KANA", "CJK"))


# Our own sample sentences, from which the trigram profiles are made together with the function words.
SAMPLES = {
    "en": "the old house near the river was built by a family of traders who came from the coast. they sold cloth and salt for many years until the harbour was closed. today it is a small museum that shows how people lived and worked at that time. visitors can walk through the rooms and read what the owners wrote in their letters.",
    "fr": "la vieille maison près de la rivière fut construite par une famille de marchands venue de la côte. ils vendaient du drap et du sel pendant de longues années, jusqu'à la fermeture du port. aujourd'hui c'est un petit musée qui montre comment les gens vivaient et travaillaient à cette époque. les visiteurs peuvent parcourir les chambres et lire ce que les propriétaires écrivaient dans leurs lettres.",
    "de": "das alte haus am fluss wurde von einer familie von händlern gebaut, die von der küste kam. sie verkauften viele jahre lang tuch und salz, bis der hafen geschlossen wurde. heute ist es ein kleines museum, das zeigt, wie die menschen damals lebten und arbeiteten. besucher können durch die zimmer gehen und lesen, was die besitzer in ihren briefen schrieben.",
    "es": "la vieja casa junto al río fue construida por una familia de comerciantes que vino de la costa. vendieron tela y sal durante muchos años hasta que se cerró el puerto. hoy es un pequeño museo que muestra cómo vivía y trabajaba la gente en aquella época. los visitantes pueden recorrer las habitaciones y leer lo que los dueños escribían en sus cartas.",
    "it": "la vecchia casa vicino al fiume fu costruita da una famiglia di mercanti venuta dalla costa. vendettero stoffa e sale per molti anni, finché il porto fu chiuso. oggi è un piccolo museo che mostra come la gente viveva e lavorava in quel tempo. i visitatori possono girare per le stanze e leggere quello che i proprietari scrivevano nelle loro lettere.",
    "pt": "a velha casa junto ao rio foi construída por uma família de comerciantes que veio da costa. venderam pano e sal durante muitos anos, até que o porto foi fechado. hoje é um pequeno museu que mostra como as pessoas viviam e trabalhavam naquela época. os visitantes podem andar pelos quartos e ler o que os donos escreviam nas suas cartas.",
    "nl": "het oude huis aan de rivier werd gebouwd door een familie van handelaren die van de kust kwam. ze verkochten jarenlang laken en zout, tot de haven werd gesloten. nu is het een klein museum dat laat zien hoe de mensen toen leefden en werkten. bezoekers kunnen door de kamers lopen en lezen wat de eigenaren in hun brieven schreven.",
    "pl": "stary dom nad rzeką został zbudowany przez rodzinę kupców, która przyszła z wybrzeża. przez wiele lat sprzedawali sukno i sól, aż port został zamknięty. dziś jest to małe muzeum, które pokazuje, jak ludzie żyli i pracowali w tamtym czasie. zwiedzający mogą przejść przez pokoje i przeczytać, co właściciele pisali w swoich listach. położony jest w pobliżu stolicy i należy do miasta.",
    "cs": "starý dům u řeky postavila rodina obchodníků, která přišla z pobřeží. mnoho let prodávali sukno a sůl, dokud nebyl přístav uzavřen. dnes je to malé muzeum, které ukazuje, jak lidé v té době žili a pracovali. návštěvníci mohou projít pokoji a číst, co majitelé psali ve svých dopisech. leží v blízkosti hlavního města.",
    "sv": "det gamla huset vid floden byggdes av en familj av köpmän som kom från kusten. de sålde tyg och salt i många år tills hamnen stängdes. idag är det ett litet museum som visar hur människor levde och arbetade på den tiden. besökare kan gå genom rummen och läsa vad ägarna skrev i sina brev. det ligger nära huvudstaden.",
    "da": "det gamle hus ved floden blev bygget af en familie af købmænd, som kom fra kysten. de solgte klæde og salt i mange år, indtil havnen blev lukket. i dag er det et lille museum, der viser, hvordan folk levede og arbejdede på den tid. besøgende kan gå gennem værelserne og læse, hvad ejerne skrev i deres breve.",
    "ro": "casa veche de lângă râu a fost construită de o familie de negustori care a venit de pe coastă. au vândut pânză și sare mulți ani, până când portul a fost închis. astăzi este un mic muzeu care arată cum trăiau și munceau oamenii în acea vreme. vizitatorii pot merge prin camere și pot citi ce scriau proprietarii în scrisorile lor.",
    "tr": "nehrin yanındaki eski ev, kıyıdan gelen bir tüccar ailesi tarafından yapıldı. liman kapanana kadar uzun yıllar kumaş ve tuz sattılar. bugün insanların o zamanlar nasıl yaşadığını ve çalıştığını gösteren küçük bir müzedir. ziyaretçiler odaları gezebilir ve sahiplerinin mektuplarında yazdıklarını okuyabilir. başkente yakın bir yerde bulunur.",
    "hu": "a folyó melletti régi házat egy kereskedőcsalád építette, amely a partról érkezett. sok éven át posztót és sót árultak, amíg a kikötőt be nem zárták. ma egy kis múzeum, amely megmutatja, hogyan éltek és dolgoztak az emberek abban az időben. a látogatók végigjárhatják a szobákat, és elolvashatják, mit írtak a tulajdonosok a leveleikben.",
    "fi": "vanhan talon joen rannalla rakensi kauppiasperhe, joka tuli rannikolta. he myivät kangasta ja suolaa monta vuotta, kunnes satama suljettiin. nykyään se on pieni museo, joka näyttää, miten ihmiset elivät ja työskentelivät siihen aikaan. kävijät voivat kulkea huoneiden läpi ja lukea, mitä omistajat kirjoittivat kirjeissään. se sijaitsee lähellä pääkaupunkia.",
}
LANGUAGES = tuple(SAMPLES)
#: Small words a text needs for its trigrams to count, and by how much (nats a trigram, times the root of their number) another language must be likelier.
LEAST_WORDS, MARGIN = 4, 3.2
# Letters beyond a to z that words in small letters may hold, loan words included.
ALPHABETS = {"en": "éèêëïîôöüàâçñæœ", "fr": "àâäæçéèêëîïôöœùûüÿñ", "de": "äöüßéèàçâê", "es": "áéíóúüñç"}


def _trigrams(words: list[str]) -> list[str]:
    return [x[i : i + 3] for w in words for x in (f" {w} ",) for i in range(len(x) - 2)]


@cache
def _profiles() -> tuple[dict[str, int], np.ndarray]:
    """Row of each known trigram, and its log-likelihood in each language, all profiles scaled to one size; row 0 is for unknown ones."""
    counts = []
    for k in LANGUAGES:
        c = Counter(_trigrams(_WORD.findall(SAMPLES[k])))
        if k in FUNCTION_WORDS:
            c.update(_trigrams(FUNCTION_WORDS[k].split()))
        scale = 1000 / c.total()
        counts.append({t: n * scale for t, n in c.items()})
    rest = 0.2
    total = math.log(1000 + rest * 5000)
    known = ["", *sorted({t for c in counts for t in c})]
    return {t: i for i, t in enumerate(known)}, np.array([[math.log(c.get(t, 0) + rest) - total for c in counts] for t in known])


def likelihoods(text: str) -> tuple[dict[str, float], int]:
    """Mean log-likelihood of the trigrams of the words in small letters, by language, and their number; fewer than LEAST_WORDS words give none."""
    small = [w for w in _WORD.findall(text) if w.islower()]
    if len(small) < LEAST_WORDS:
        return {}, 0
    row_of, table = _profiles()
    rows = [row_of.get(t, 0) for t in _trigrams(small)]
    return dict(zip(LANGUAGES, table[rows].mean(0).tolist())), len(rows)


def other_profile(question: str, answer: str) -> bool:
    """Whether the answer's trigrams are likelier in another language than in any the question may be in, or two of its words need letters that these languages lack."""
    asked = [k for k in languages(question) if k in SAMPLES]
    if not asked:
        return False
    if all(k in ALPHABETS for k in asked):
        own = set("abcdefghijklmnopqrstuvwxyz").union(*(ALPHABETS[k] for k in asked))
        if len({w for w in _WORD.findall(answer) if w.islower() and not own.issuperset(w)}) >= 2:
            return True
    score, n = likelihoods(answer)
    return n > 0 and max(score.values()) > max(score[k] for k in asked) + MARGIN / math.sqrt(n)
