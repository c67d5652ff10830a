"""Stemmers by regions and ordered steps, after the published Snowball descriptions, for six languages.

A language is a list of steps. A step is a list of endings with what to do; the longest ending that the word has counts,
and is done only if it lies in its region:

    R1  after the first consonant that follows a vowel;  R2  the same within R1
    RV  by the language's own rule, near the start of the word

What is done: a text to put in its place, and endings to take off before it in turn (if they lie in R2). Endings, what
takes their place and the regions are fixed values that must be those of the descriptions. Hungarian and Italian have
fewer of the rare verb forms than there.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field


@dataclass
class Rule:
    endings: str
    region: str = "R2"
    to: str = ""
    #: Endings that may stand before, taken off (or replaced: a>b) if they lie in R2.
    before: str = ""
    #: What must stand before the ending, as a regular expression.
    after: str = ""
    #: With ``else_in``, what the ending becomes if it lies there and not in ``region``.
    else_to: str = ""
    else_in: str = ""
    fit: list[str] = field(init=False)

    def __post_init__(self):
        self.fit = self.endings.split()


@dataclass
class Language:
    vowels: str
    rv: str
    #: Steps: name, rules, names of steps that must have changed nothing, names of which one must have changed the word.
    steps: list[tuple[str, list[Rule], str, str]]
    least_r1: int = 0
    prepare: list[tuple[str, str]] = field(default_factory=list)
    finish: list[tuple[str, str]] = field(default_factory=list)
    keep_accents: bool = True


def regions(word: str, vowels: str, rv: str, least_r1: int = 0) -> dict[str, int]:
    """Where R1, R2 and RV begin."""
    v, c = f"[{vowels}]", f"[^{vowels}]"

    def after(start: int) -> int:
        m = re.compile(f"{v}{c}").search(word, start)
        return m.end() if m else len(word)

    r1 = after(0)
    out = {"R1": max(r1, least_r1), "R2": after(r1), "RV": len(word), "ALL": 0}
    if rv == "romance" and len(word) > 1:
        # Second letter a consonant: after the next vowel; two vowels: after the next consonant; else after the third letter.
        if re.match(c, word[1]):
            m = re.compile(v).search(word, 2)
            out["RV"] = m.end() if m else len(word)
        elif re.match(v, word[0]):
            m = re.compile(c).search(word, 2)
            out["RV"] = m.end() if m else len(word)
        else:
            out["RV"] = min(3, len(word))
    elif rv == "french":
        if re.match(f"{v}{v}|par|col|tap", word):
            out["RV"] = min(3, len(word))
        else:
            m = re.compile(v).search(word, 1)
            out["RV"] = m.end() if m else len(word)
    return out


def _stepped(word: str, rules: list[Rule], at: dict[str, int]) -> str:
    """The word after a step: the longest of all endings that it has decides."""
    best = max(((e, r) for r in rules for e in r.fit if word.endswith(e) and (not r.after or re.search(f"(?:{r.after})$", word[: len(word) - len(e)]))), key=lambda x: len(x[0]), default=None)
    if best is None:
        return word
    ending, rule = best
    stem = word[: len(word) - len(ending)]
    if len(stem) < at[rule.region]:
        return stem + rule.else_to if rule.else_in and len(stem) >= at[rule.else_in] else word
    stem += rule.to
    for chain in rule.before.split("|") if rule.before else ():
        for part in chain.split():
            old, _, new = part.partition(">")
            if stem.endswith(old):
                if len(stem) - len(old) >= at["R2"]:
                    stem = stem[: len(stem) - len(old)] + new
                    break
                return stem
        else:
            break
    return stem


def stemmed(word: str, language: Language) -> str:
    for pattern, to in language.prepare:
        word = re.sub(pattern, to, word)
    at, changed = regions(word, language.vowels, language.rv, language.least_r1), set()
    for name, rules, unless, only in language.steps:
        if changed & set(unless.split(",")) or only and not changed & set(only.split(",")):
            continue
        new = _stepped(word, rules, at)
        if new != word:
            changed.add(name)
            word = new
    for pattern, to in language.finish:
        word = re.sub(pattern, to, word)
    return word


_ACUTE = [("á", "a"), ("é", "e"), ("í", "i"), ("ó", "o"), ("ú", "u")]

SPANISH = Language(
    "aeiouáéíóúü", "romance",
    [
        ("pronoun", [Rule("me se sela selo selas selos la le lo las les los nos", "RV", after="ando|iendo|ar|er|ir|ándo|iéndo|ár|ér|ír|uyendo")], "", ""),
        ("accent", [Rule("iéndo", "RV", to="iendo"), Rule("ándo", "RV", to="ando"), Rule("ár", "RV", to="ar"), Rule("ér", "RV", to="er"), Rule("ír", "RV", to="ir")], "", "pronoun"),
        ("standard", [
            Rule("anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos"),
            Rule("adora ador ación adoras adores aciones ante antes ancia ancias", before="ic"),
            Rule("logía logías", to="log"), Rule("ución uciones", to="u"), Rule("encia encias", to="ente"),
            Rule("amente", "R1", before="iv os ic ad|at"), Rule("mente", before="ante able ible"),
            Rule("idad idades", before="abil ic iv"), Rule("iva ivo ivas ivos", before="at"),
        ], "", ""),
        ("y verbs", [Rule("ya ye yan yen yeron yendo yo yó yas yes yais yamos", "RV", after="u")], "standard", ""),
        ("verbs", [
            Rule("en es éis emos", "RV"),
            Rule("arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos", "RV"),
        ], "standard,y verbs", ""),
        ("rest", [Rule("os a o á í ó", "RV"), Rule("e é", "RV")], "", ""),
    ],
    finish=[("gu$", "g"), *_ACUTE],
)

FRENCH = Language(
    "aeiouyâàëéêèïîôûù", "french",
    [
        ("standard", [
            Rule("ance iqUe isme able iste eux ances iqUes ismes ables istes"),
            Rule("atrice ateur ation atrices ateurs ations", before="ic>"),
            Rule("logie logies", to="log"), Rule("usion ution usions utions", to="u"), Rule("ence ences", to="ent"),
            Rule("ement ements", "RV", before="iv eus abl iqU|at"), Rule("ité ités", before="abil>abl ic>iqU iv>"),
            Rule("if ive ifs ives", before="at>|ic>iqU"), Rule("eaux", "ALL", to="eau"), Rule("aux", "R1", to="al"),
            Rule("euse euses", else_to="eux", else_in="R1"), Rule("issement issements", "R1", after="[^aeiouyâàëéêèïîôûù]"),
        ], "", ""),
        ("adverbs", [Rule("amment", "RV", to="ant"), Rule("emment", "RV", to="ent"), Rule("ment ments", "RV", after="[aeiouyâàëéêèïîôûù]")], "standard", ""),
        ("i verbs", [Rule("îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante issantes issants isse issent isses issez issiez issions issons it", "RV", after="[^aeiouyâàëéêèïîôûù]")], "standard", ""),
        ("verbs", [
            Rule("ions"), Rule("é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez", "RV"),
            Rule("âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions eai eaIent eais eait eant eas easse", "RV"),
        ], "standard,i verbs", ""),
        ("y", [Rule("Y", "ALL", to="i"), Rule("ç", "ALL", to="c")], "", "standard,adverbs,i verbs,verbs"),
        ("s", [Rule("s", "ALL", after="[^aiouès]")], "standard,adverbs,i verbs,verbs", ""),
        ("rest", [Rule("ion", "R2", after="[st]"), Rule("ier ière Ier Ière", "RV", to="i"), Rule("e", "RV")], "standard,adverbs,i verbs,verbs", ""),
    ],
    prepare=[("(?<=[aeiouyâàëéêèïîôûù])u(?=[aeiouyâàëéêèïîôûù])", "U"), ("(?<=q)u", "U"), ("(?<=[aeiouyâàëéêèïîôûù])i(?=[aeiouyâàëéêèïîôûù])", "I"), ("(?<=[aeiouyâàëéêèïîôûù])y|y(?=[aeiouyâàëéêèïîôûù])", "Y")],
    finish=[("(enn|onn|ett|ell|eill)$", lambda m: m[1][:-1]), ("[éè]([^aeiouyâàëéêèïîôûù]+)$", r"e\1"), ("[UIY]", lambda m: m[0].lower())],
)

PORTUGUESE = Language(
    "aeiouáéíóúâêô", "romance",
    [
        ("standard", [
            Rule("eza ezas ico ica icos icas ismo ismos ável ível ista istas oso osa osos osas amento amentos imento imentos adora ador aça~o adoras adores aço~es ante antes ância"),
            Rule("logia logias", to="log"), Rule("uça~o uço~es", to="u"), Rule("ência ências", to="ente"),
            Rule("amente", "R1", before="iv os ic ad|at"), Rule("mente", before="ante avel ível"),
            Rule("idade idades", before="abil ic iv"), Rule("iva ivo ivas ivos", before="at"), Rule("ira iras", "RV", to="ir", after="e"),
        ], "", ""),
        ("verbs", [Rule("ada ida ia aria eria iria ará ara erá era irá ava asse esse isse aste este iste ei arei erei irei am iam ariam eriam iriam aram eram iram avam em arem erem irem assem essem issem ado ido ando endo indo ara~o era~o ira~o ar er ir as adas idas ias arias erias irias arás aras erás eras irás avas es ardes erdes irdes ares eres ires asses esses isses astes estes istes is ais eis íeis aríeis eríeis iríeis áreis areis éreis ereis íreis ireis ásseis ésseis ísseis áveis ados idos ámos amos íamos aríamos eríamos iríamos áramos éramos íramos ávamos emos aremos eremos iremos ássemos êssemos íssemos imos armos ermos irmos eu iu ou ira iras", "RV")], "standard", ""),
        ("i", [Rule("i", "RV", after="c")], "", "standard,verbs"),
        ("rest", [Rule("os a i o á í ó", "RV")], "standard,verbs", ""),
        ("e", [Rule("e é ê", "RV")], "", ""),
    ],
    prepare=[("ã", "a~"), ("õ", "o~")],
    finish=[("ç$", "c"), ("a~", "ã"), ("o~", "õ")],
)

ITALIAN = Language(
    "aeiouàèìòù", "romance",
    [
        ("pronoun", [Rule("ci gli la le li lo mi ne si ti vi sene gliela gliele glieli glielo gliene mela mele meli melo mene tela tele teli telo tene cela cele celi celo cene vela vele veli velo vene", "RV", after="ando|endo|ar|er|ir")], "", ""),
        ("standard", [
            Rule("anza anze ico ici ica ice iche ichi ismo ismi abile abili ibile ibili ista iste isti istà istè istì oso osi osa ose mente atrice atrici ante anti"),
            Rule("azione azioni atore atori", before="ic"), Rule("logia logie", to="log"), Rule("uzione uzioni usione usioni", to="u"), Rule("enza enze", to="ente"),
            Rule("amento amenti imento imenti", "RV"), Rule("amente", "R1", before="iv os ic abil|at"), Rule("ità", before="abil ic iv"), Rule("ivo ivi iva ive", before="at|ic"),
        ], "", ""),
        ("verbs", [Rule("ammo ando ano are arono asse assero assi assimo ata ate ati ato ava avamo avano avate avi avo emmo enda ende endi endo erà erai eranno ere erebbe erebbero erei eremmo eremo ereste eresti erete erò erono essero ete eva evamo evano evate evi evo Yamo iamo immo irà irai iranno ire irebbe irebbero irei iremmo iremo ireste iresti irete irò irono isca iscano isce isci isco iscono issero ita ite iti ito iva ivamo ivano ivate ivi ivo ono uta ute uti uto ar ir", "RV")], "standard", ""),
        ("rest", [Rule("ia ie ii io ià iè iì iò a e i o à è ì ò", "RV")], "", ""),
    ],
    prepare=[("á", "à"), ("é", "è"), ("í", "ì"), ("ó", "ò"), ("ú", "ù")],
    finish=[("([cg])h$", r"\1")],
)

DUTCH = Language(
    "aeiouyè", "none",
    [
        ("plural", [Rule("heden", "R1", to="heid"), Rule("en ene", "R1", after="(?<!gem)[^aeiouyè]"), Rule("s se", "R1", after="[^aeiouyèj]")], "", ""),
        ("e", [Rule("e", "R1", after="[^aeiouyè]")], "", ""),
        ("heid", [Rule("heid", "R2", after="[^c]", before="en")], "", ""),
        ("endings", [Rule("end ing", "R2", before="ig"), Rule("ig", "R2", after="[^e]"), Rule("baar", "R2")], "", ""),
        ("lijk", [Rule("lijk", "R2")], "", ""),
        ("e again", [Rule("e", "R1", after="[^aeiouyè]")], "", "lijk"),
    ],
    least_r1=3, prepare=[("[äá]", "a"), ("[ëé]", "e"), ("[ïí]", "i"), ("[öó]", "o"), ("[üú]", "u")],
    finish=[("(kk|dd|tt|nn|mm|ff)$", lambda m: m[1][0]), ("([^aeiouy])(aa|ee|oo|uu)([^aeiouyI])$", lambda m: m[1] + m[2][0] + m[3])],
)

HUNGARIAN = Language(
    "aáeéiíoóöőuúüű", "none",
    [
        ("instrumental", [Rule("al el", "R1", after=r"([bcdfghjklmnprstvz])\1")], "", ""),
        ("case", [Rule("ban ben ba be ra re nak nek val vel tól től ról ről ból ből hoz hez höz nál nél ig at et ot öt ért képp képpen kor ul ül vá vé onként enként anként ként en on an ön n t", "R1")], "", ""),
        ("accent", [Rule("á", "R1", to="a"), Rule("é", "R1", to="e")], "", "case"),
        ("factive", [Rule("á é", "R1", after=r"([bcdfghjklmnprstvz])\1")], "", ""),
        ("owned", [Rule("oké öké aké eké ké éi é", "R1")], "", ""),
        ("owner", [Rule("ünk unk nk juk jük uk ük em om am m od ed ad öd d ja je a e o jaim jeim aim eim im jaid jeid aid eid id jai jei ai ei i jaink jeink eink aink ink jaitok jeitek aitok eitek itek jeik jaik aik eik ik", "R1")], "", ""),
        ("plural", [Rule("ök ok ek ak k", "R1")], "", ""),
    ],
    finish=[(r"([bcdfghjklmnprstvz])\1$", r"\1")],
)

LANGUAGES = {"es": SPANISH, "fr": FRENCH, "pt": PORTUGUESE, "it": ITALIAN, "nl": DUTCH, "hu": HUNGARIAN}


def stem(word: str, lang: str) -> str:
    """The stem of a lower-case word; words of other languages, and of two letters or fewer, stay."""
    word = unicodedata.normalize("NFC", word)
    return stemmed(word, LANGUAGES[lang]) if lang in LANGUAGES and len(word) > 2 else word
