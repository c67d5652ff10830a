"""The tagged-sentence grammar against a recogniser without memory, and what it reads of whole texts."""

import random

import pytest

from skein.nlp import lemma, peg, stem


def plain(e, tokens, at):
    """(end, slots) or None, by the meaning of the expressions alone."""
    if isinstance(e, str):
        fit = at < len(tokens) and (tokens[at][1] == e if e.isupper() or e.endswith("$") else tokens[at][0].lower() in e.split("|"))
        return (at + 1, []) if fit else None
    kind, parts = e[0], e[1:]
    if kind == "is":
        return plain(peg.GRAMMAR[parts[0]], tokens, at)
    if kind == "slot":
        found = plain(parts[1], tokens, at)
        return None if found is None else (found[0], found[1] + [(parts[0], at, found[0])])
    if kind == "not":
        return (at, []) if plain(parts[0], tokens, at) is None else None
    if kind == "first":
        tries = [plain(p, tokens, at) for p in parts]
        return next((t for t in tries if t is not None), None)
    if kind == "seq":
        if not parts:
            return at, []
        found = plain(parts[0], tokens, at)
        rest = None if found is None else plain(("seq", *parts[1:]), tokens, found[0])
        return None if rest is None else (rest[0], found[1] + rest[1])
    found = plain(parts[0], tokens, at)
    if found is None or found[0] == at:
        return None if kind == "some" else (at, [])
    if kind == "maybe":
        return found
    more = plain(("any", parts[0]), tokens, found[0])
    return more[0], found[1] + more[1]


def test_memo_changes_nothing():
    rng = random.Random(3)
    words = [("a", "DT"), ("red", "JJ"), ("dog", "NN"), ("is", "BE"), ("of", "IN"), ("in", "IN"), ("can", "MD"), ("run", "VB"), ("eaten", "VBN"), ("by", "IN"), ("running", "VBG"), ("for", "IN"), ("it", "PRP"), ("not", "RB"), ("has", "VBZ"), ("used", "VBN"), ("to", "TO")]
    found = 0
    for _ in range(3000):
        noun = lambda: rng.choice([words[:1] + words[2:3], words[1:3], words[2:3], words[:3], words[12:13]])
        tokens = noun() + [rng.choice(words) for _ in range(rng.randrange(0, 3))] + rng.choice([words[3:4], words[6:7], words[14:15]]) + [rng.choice(words) for _ in range(rng.randrange(0, 3))] + noun()
        want = None
        for relation, e in peg.RELATIONS:
            got = plain(e, tokens, 0)
            if got and got[0] == len(tokens):
                said = {k: " ".join(w for w, _ in tokens[a:b]) for k, a, b in got[1]}
                want = (relation, said[1], said[2])
                break
        assert peg.assertion(tokens) == want
        found += want is not None
    assert found > 50


@pytest.mark.parametrize("text,relation,one,two", [
    ("the/DT dog/NN is/BE an/DT animal/NN", "IsA", "the dog", "an animal"),
    ("a/DT knife/NN is/BE used/VBN for/IN cutting/VBG bread/NN", "UsedFor", "a knife", "cutting bread"),
    ("a/DT knife/NN is/BE used/VBN to/TO cut/VB bread/NN", "UsedFor", "a knife", "cut bread"),
    ("a/DT wheel/NN is/BE part/NN of/IN a/DT car/NN", "PartOf", "a wheel", "a car"),
    ("books/NNS are/BE on/IN the/DT table/NN", "AtLocation", "books", "the table"),
    ("the/DT inn/NN is/BE near/IN a/DT river/NN", "LocatedNear", "the inn", "a river"),
    ("sound/NN can/MD be/BE recorded/VBN", "ReceivesAction", "sound", "recorded"),
    ("birds/NNS can/MD sing/VB a/DT song/NN", "CapableOf", "birds", "sing a song"),
    ("roses/NNS are/BE very/RB red/JJ", "HasProperty", "roses", "very red"),
    ("bread/NN is/BE made/VBN of/IN flour/NN", "MadeOf", "bread", "flour"),
    ("songs/NNS are/BE written/VBN by/IN poets/NNS", "CreatedBy", "songs", "poets"),
    ("a/DT cat/NN has/VBZ whiskers/NNS", "HasA", "a cat", "whiskers"),
    ("rain/NN causes/VBZ floods/NNS", "Causes", "rain", "floods"),
    ("a/DT child/NN wants/VBZ to/TO play/VB", "Desires", "a child", "play"),
    ("hunger/NN makes/VBZ you/PRP want/VB to/TO eat/VB", "CausesDesire", "hunger", "eat"),
    ("driving/VBG requires/VBZ a/DT licence/NN", "HasPrerequisite", "driving", "a licence"),
    ("cooking/VBG involves/VBZ cutting/VBG", "HasSubevent", "cooking", "cutting"),
    ("running/VBG is/BE done/VBN for/IN health/NN", "MotivatedByGoal", "running", "health"),
    ("a/DT square/NN is/BE defined/VBN as/IN a/DT figure/NN", "DefinedAs", "a square", "a figure"),
])
def test_each_relation_has_a_sentence(text, relation, one, two):
    assert peg.assertion([tuple(w.split("/")) for w in text.split()]) == (relation, one, two)
    assert len({r for r, _ in peg.RELATIONS}) == 20


def test_words_and_tags_of_whole_texts(spark):
    docs = spark.createDataFrame([(1, 'The glorp is red. "A glorp" is in the wug!\nglorps wug'), (2, None), (3, ""), (4, "x " * 5000 + "is y")], "doc_id long, text string")
    words = peg.sentences(docs, "doc_id", "text")
    told = {(r["doc_id"], r["sentence"], r["place"]): (r["word"], r["tag"]) for r in peg.tagged(words, "doc_id").collect()}
    assert [told[1, 0, k] for k in range(4)] == [("The", "DT"), ("glorp", "NN"), ("is", "BE"), ("red", "JJ")]
    assert told[1, 1, 5] == ("wug", "NN") and told[1, 2, 0] == ("glorps", "NNS") and len(told) == 4 + 6 + 2 + 5002
    got = sorted((r["sentence"], r["relation"], r["text1"], r["text2"]) for r in peg.assertions(peg.tagged(words, "doc_id"), "doc_id").collect() if r["doc_id"] == 1)
    assert got[:2] == [(0, "HasProperty", "The glorp", "red"), (1, "AtLocation", "A glorp", "the wug")]
    assert peg.assertions(peg.tagged(words.limit(0), "doc_id"), "doc_id").count() == 0


PAIRS = [("walks", "walk", 3), ("talks", "talk", 2), ("stories", "story", 2), ("cities", "city", 2), ("boxes", "box", 1), ("making", "make", 2), ("walking", "walk", 4), ("baking", "bake", 1)]


def test_endings_are_told_by_the_longest_path(spark):
    trie = lemma.SuffixTrie.of([(s, cut, add, n) for s, cut, add, n in [("s", 1, "", 5), ("ies", 3, "y", 4), ("es", 2, "", 1), ("ing", 3, "", 4), ("king", 3, "e", 3), ("lking", 3, "", 2)]])
    assert [trie.lemma(w) for w in ("ladies", "cats", "foxes", "waking", "stalking", "sing", "ing", "", "élan", "éks")] == ["lady", "cat", "foxe", "wake", "stalk", "s", "ing", "", "élan", "ék"]
    rules = lemma.suffix_rules(spark.createDataFrame(PAIRS, "word string, lemma string, n long"), 4, 2)
    got = {(r["suffix"], r["cut"], r["add"]): r["n"] for r in rules.collect()}
    assert got["ies", 3, "y"] == 2 and got["s", 1, ""] == 2 and ("es", 2, "") not in got and got["king", 3, "e"] == 2 and ("lking", 3, "") not in got
    assert ("ing", 3, "e") in got  # of two changes of one count the smaller one


def test_families_of_the_words_of_a_table(spark):
    words = "walk walks walking talk talks talking bake baking bakes make making makes box boxes fox foxes nothing".split()
    counts = spark.createDataFrame([(w, 5) for w in words] + [("x", 1), ("s", 1)], "word string, n long")
    pairs = {r["word"]: r["lemma"] for r in lemma.word_families(counts).collect()}
    assert pairs == {"walks": "walk", "walking": "walk", "talks": "talk", "talking": "talk", "baking": "bake", "bakes": "bake", "making": "make", "makes": "make", "boxes": "box", "foxes": "fox"}
    got = {r["word"]: r["lemma"] for r in lemma.lemmas_of(counts, least=2).collect()}
    assert got["walks"] == "walk" and got["foxes"] == "fox" and got["baking"] == "bake" and got["box"] == "box" and len(got) == len(words) + 2
    assert lemma.lemmas_of(counts.limit(0)).count() == 0


def test_more_rules_than_a_trie_may_have_tell_the_same(spark):
    """of many rules none is dropped; beyond the bound they are joined by suffix."""
    stems = "walk talk bake make box fox story city play stay rate date hope note jump help élan".split()
    words = [w for s in stems for w in (s, *(lemma.inflect(s, e) for e in lemma.ENDINGS))]
    unknown = "blorps blorping gries fries zaking s es ing g é xés ies sings lumped rarer".split()
    counts = spark.createDataFrame([(w, 3) for w in dict.fromkeys(words + unknown)] + [("", 1), (None, 2)], "word string, n long")
    whole = sorted(map(str, lemma.lemmas_of(counts).collect()))
    assert "Row(word='blorping', lemma='blorp')" in whole and "Row(word='gries', lemma='gry')" in whole
    for most in (0, 1, 5):
        assert sorted(map(str, lemma.lemmas_of(counts, most_rules=most).collect())) == whole
    assert lemma.lemmas_of(counts.limit(0), most_rules=-1).count() == 0


STEMS = {
    "es": "corriendo corr corría corr amablemente amabl rápidamente rapid naciones nacion nación nacion ciudades ciudad hablábamos habl canciones cancion activamente activ biológica biolog chicas chic gatos gat pague pag comprándolo compr",
    "fr": "continuation continu continuellement continuel chanteuse chanteux majestueusement majestu nationaux national finissait fin mangeaient mang chevaux cheval activité activ activités activ religieuse religi rapidement rapid constamment const maisons maison grandes grand",
    "pt": "quilométricas quilométr trabalhadores trabalh nações naçõ felizmente feliz cantando cant canções cançõ",
    "it": "pronunciato pronunc propaganda propagand abbandonata abbandon nazioni nazion felicemente felic cantando cant mangiarlo mang città citt",
    "nl": "lichamelijk licham opglimlachten opglimlacht gelegenheden geleg boeken boek katten kat maken mak vrijheid vrijheid dankbaar dankbar",
    "hu": "kutyával kuty embereknek ember",
    "de": "Häuser Häuser",
}


@pytest.mark.parametrize("lang", sorted(STEMS))
def test_stems_as_the_descriptions_have_them(lang):
    pairs = STEMS[lang].split()
    assert [stem.stem(w, lang) for w in pairs[::2]] == pairs[1::2]


def test_regions_of_words():
    # Examples of the published descriptions.
    assert stem.regions("beautiful", "aeiouy", "none")["R1"] == 5 and stem.regions("beautiful", "aeiouy", "none")["R2"] == 7
    spanish = lambda w: w[stem.regions(w, stem.SPANISH.vowels, "romance")["RV"] :]
    assert [spanish(w) for w in ("macho", "oliva", "trabajo", "áureo")] == ["ho", "va", "bajo", "eo"]
    french = lambda w: w[stem.regions(w, stem.FRENCH.vowels, "french")["RV"] :]
    assert [french(w) for w in ("aimer", "adorer", "voler", "tapis")] == ["er", "rer", "ler", "is"]


def test_stems_of_odd_words():
    rng = random.Random(1)
    for lang in stem.LANGUAGES:
        for _ in range(300):
            word = "".join(rng.choice("aeiouylnrstmdcgáéíóúàèìòùãõçhkőű") for _ in range(rng.randrange(0, 14)))
            assert len(stem.stem(word, lang)) <= len(word) + 3
