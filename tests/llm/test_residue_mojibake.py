import random

import pytest

from planloom.llm import mojibake, residue

RESIDUE = [
    "bring me the {object} from the kitchen", "go to the {{ room }}", "find ${name} in the hall", "salute %(person_name)s", "take the <target> off the shelf",
    "go to the [insert room name here]", "meet (choose a username) at the door", "pick up the #N/A", "carry it to undefined in the hall", "locate the null in the chapel",
    "Lorem ipsum dolor sit amet", "TBD", "your command goes here", "asdf asdf qwer", "sample text for layout only", "placeholder",
    "404 Not Found", "Internal server error", "The page could not be found. Reference id 8f2", "your request timed out", "Traceback (most recent call last): KeyError",
    "<html><body><h1>x</h1></body></html>", "Please enable JavaScript to continue", "You must turn on client-side scripting", "we use cookies. accept all to see this content",
    "find the cup in the hall | 502 Bad Gateway", "please activate JavaScript and cookies to view this page",
]
CLEAN = [
    "bring the JavaScript handbook from the shelf to Anna", "tell Anna that the server forgot the soup", "find Anna in the hall <slowly>", "take the cup (the left one) from the tray",
    "hand the empty form on the lectern to Anna", "put the placeholder card from the crate in the hall", "find the cup [urgent]", "locate the null marker of the scale on the desk for Anna",
    "take the none too clean mat off the trolley for Anna", "ask Anna whether the service entrance is unavailable", "take the cup from the kiosk; cost $5 at the hall", "ask Anna to enable the script printer",
    'tell Anna "access denied" is the title of the play in the hall', "find Anna, badge <7>, in the hall", "say to Anna that the request for the globe was refused", None, "", "  ",
]


def found(spark, rows):
    df = spark.createDataFrame(rows, "variant_id long, input string, goals array<string>, source string, h string, kind string")
    return {r.variant_id: r.kinds for r in residue.residue(df, "variant_id", "input", "goals", "source").collect()}


def test_inputs(spark):
    rows = [(i, t, ["go(hall)"], "s", "h", "k") for i, t in enumerate(RESIDUE + CLEAN)]
    assert set(found(spark, rows)) == set(range(len(RESIDUE)))


def test_slots_without_symbols(spark):
    texts = ["go to your room here", "bring YOUR-OBJECT-HERE to Anna", "bring your cup here", "wait here for Anna"]
    assert set(found(spark, [(i, t, ["go(hall)"], "s", "h", "k") for i, t in enumerate(texts)])) == {0, 1}


def test_goals(spark):
    bad = [["talk('insert text')"], ["talk('PLACEHOLDER')"], ["go(na)"], ["go({0})"], ["go(hall)", "find(null)"], ["talk('lorem ipsum')"], ["503 service unavailable"], ["go(____)"], ["find([insert name here], kind=person)"]]
    good = [["go(hall)", "find(person, gesture='waving person')"], None, [], [None, "answer_question()"], ["talk('the server forgot the soup')"], ["tell(object, property=softest)"]]
    rows = [(i, "go to the hall", g, None, None, None) for i, g in enumerate(bad + good)]
    assert set(found(spark, rows)) == set(range(len(bad)))


def test_recurrence_decides(spark):
    """A weak phrase is residue where its message recurs over sources, and only there; numbers and dates do not part a message."""
    wide = [(i, f"planner template {i} unavailable", ["go(hall)"], f"s{i % 2}", "", "") for i in range(3)]
    one_source = [(10 + i, f"voucher expired on 2024-01-0{i + 1}", ["go(hall)"], "s0", "", "") for i in range(5)]
    few = [(20 + i, "loading", ["go(hall)"], f"s{i}", "", "") for i in range(2)]
    commands = [(30 + i, "bring the boilerplate to the hall", ["go(hall)"], f"s{i % 2}", "", "") for i in range(4)]
    got = found(spark, wide + one_source + few + commands)
    assert got == {i: ["input:recurring_message"] for i in range(3)}


def test_a_new_line_ends_a_notice(spark):
    texts = ["for full functionality switch on javascript\nbob is at the desk, greet them", "enable\njavascript to continue", "enable the cookies jar lid", "turn on the script lamp in the hall", "activate scripting. go to the hall"]
    assert set(found(spark, [(i, t, ["go(hall)"], "s", "h", "k") for i, t in enumerate(texts)])) == {0, 1, 4}


def test_gate_drops_nothing(spark):
    """Every text of the rules passes the automaton."""
    assert [t for t in RESIDUE if not residue.cues_of("input", t.lower())] == []


def test_recurring_and_clean(spark):
    rows = [(i, "no data", ["go(hall)"], f"s{i % 2}", "", "") for i in range(4)] + [(9, "go to the hall", None, None, "", "")]
    assert set(found(spark, rows)) == {0, 1, 2, 3}
    df = spark.createDataFrame(rows, "variant_id long, input string, goals array<string>, source string, h string, kind string")
    kept = residue.without_residue(df, "variant_id", residue.residue(df, "variant_id", "input", "goals", "source"))
    assert [r.variant_id for r in kept.collect()] == [9]
    assert residue.residue(df.limit(0), "variant_id", "input", "goals", "source").count() == 0


SENTENCES = {
    "fr": ["Le robot s’est arrêté devant la crèche et a cherché une clé dorée.", "La réponse arrive après le dîner à l’entrée.", "Où faut-il déposer les boîtes à thé ?"],
    "de": ["Über Nacht lädt der Akku, größere Ströme sind gefährlich.", "Weiß jemand, wer den Würfel aufgeräumt hat?", "Bitte die Bühne bis zur nächsten Runde geschlossen halten."],
    "ru": ["Робот нашёл старый фонарь и подождал.", "Судья попросил повторить команду ещё раз.", "Микрофон плохо слышит последние слова."],
    "pl": ["Próba zakończyła się błędem łączności.", "Bateria wciąż się ładuje.", "Mikrofon źle usłyszał ostatnie słowo."],
}


@pytest.fixture(scope="module")
def model():
    rng = random.Random(2)
    return mojibake.train([(k, " ".join(rng.choice(v) for _ in range(6))) for k, v in SENTENCES.items() for _ in range(40)])


@pytest.mark.parametrize("wrong", ["cp1252", "latin-1", "mac_roman", "cp437", "cp1251"])
def test_round_trip(model, wrong):
    judge = mojibake.Judge(model)
    for lang, sentences in SENTENCES.items():
        for s in sentences:
            raw = s.encode()
            table = {b: ch for ch, b in reversed(mojibake._table(wrong).items())}
            bad = "".join(table[b] for b in raw)
            new, chains = judge.repair(bad)
            assert chains, (lang, bad)
            if wrong != "cp437":  # a byte may stand for a blank there
                assert new == s, (lang, wrong)


def test_single_byte_pages(model):
    judge = mojibake.Judge(model)
    for right, wrong, lang in (("cp1251", "cp1252", "ru"), ("cp1250", "cp1252", "pl"), ("koi8-r", "cp1251", "ru")):
        for s in SENTENCES[lang]:
            bad = s.encode(right).decode(wrong, "ignore")
            assert judge.repair(bad)[1], bad


def test_twice_and_entities(model):
    judge = mojibake.Judge(model)
    s = SENTENCES["fr"][1]
    twice = s.encode().decode("latin-1").encode().decode("latin-1")
    assert judge.repair(twice)[0] == s
    assert judge.repair("arrive apr&Atilde;&uml;s le d&Atilde;&reg;ner")[1]


def test_intended_characters(model):
    judge = mojibake.Judge(model)
    for text in [x for v in SENTENCES.values() for x in v] + ["plain text", "Ã is the first letter on the sign", "½″ disk, ╔══╗ plan", "naïve café", "R&D &amp; more", ""]:
        assert judge.repair(text) == (text, [])


def test_partly_garbled():
    """A garbled stretch beside a right accented letter, in pages that can encode the whole token."""

    def right(token):
        return {text for text, _, _ in mojibake.candidates(token)}

    assert "papier-mâché" in right("papier-mÃ¢ché") and "brûlée" in right("brûlÃ©e")
    assert "INSTRUÇÕES:" in right("INSTRUÇÃ•ES:") and "¿Dónde" in right("Â¿Dónde")
    assert "déjà" in right("déjÃ")  # the last byte of the stretch is lost
    for page in mojibake.AS_UTF8:
        if table := mojibake._table(page):
            of = {b: c for c, b in reversed(table.items())}
            beside = of[0xFF] if of[0xFF].isalpha() else of[0xE9]  # a letter of the page itself
            assert f"{beside}ße" in right(beside + "".join(of[b] for b in "ß".encode()) + "e"), page


def test_left_is_not_repaired(model):
    judge = mojibake.Judge(model)
    assert judge.is_left("La réponse nÂº", ["cp1252>utf-8"]) and judge.is_left("brûlÃ©e", ["cp1252>utf-8"])
    assert not judge.is_left("La réponse nº", ["cp1252>utf-8"]) and not judge.is_left("nÂº", ["lost"])


def test_refilled_texts_of_one_chain():
    """The text that was chosen is taken, not the first one of the same chain."""
    text = "La batería de la galería tenía vacíos, y la batería está à la carte."
    judge = mojibake.Judge(mojibake.train([("es", f"{text} {i}") for i in range(40)]))
    assert judge.decide("La", "baterÃa", "de la") == ("batería", "cp1252>utf-8,refilled")


def test_known_words_are_clean(model):
    """A garbled text of many copies makes no word known, and its copies are all found."""
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(v) for _ in range(6))) for k, v in SENTENCES.items() for _ in range(40)]
    bad = "La rÃ©ponse arrive aprÃ¨s le dÃ®ner Ã\xa0 l’entrÃ©e."
    copies = mojibake.train(rows + [("fr", bad)] * 50)
    assert copies == mojibake.train([*rows, ("fr", bad)]), "copies count once"
    texts = mojibake.train(rows + [("fr", f"{bad} {' '.join('ab'[i >> k & 1] for k in range(6))}") for i in range(50)])
    for m in (copies, texts):
        assert not {"rÃ©ponse", "aprÃ¨s", "dÃ®ner"} & set(m["known"])
        assert mojibake.Judge(m).repair(bad)[0].startswith("La réponse arrive après le dîner")


def test_sample_of_copies(spark):
    rows = [("Où est la clé ?", "fr")] * 2000 + [("Où est la clé ?", None)] * 3 + [(f"La crèche {chr(97 + i % 26)}{chr(97 + i // 26)} est fermée", "fr") for i in range(300)]
    seen = []
    train, mojibake.train = mojibake.train, lambda sample: seen.extend(sample) or train(sample)
    try:
        mojibake.sample_model(spark.createDataFrame(rows, "text string, lang string"), "text", "lang")
    finally:
        mojibake.train = train
    assert sorted(seen) == sorted(set((lang or "fr", text) for text, lang in rows)), "each text once, whatever the number of its copies"


def letters_of(i):
    return "".join("abcdefghij"[int(d)] for d in f"{i:04d}")


def test_model_of_all_documents(spark):
    """A letter of four documents among thousands is known: nothing is counted on a sample."""
    rows = [(i, f"La clé {letters_of(i)} est dans la crèche.", "fr") for i in range(3000)]
    rows += [(5000 + i, f"Le cœur {letters_of(i)} bat plus vite.", "fr") for i in range(4)]
    rows.append((9000, "Le cœur bat plus vite.".encode().decode("cp1252"), "fr"))
    df = spark.createDataFrame(rows, "id long, text string, lang string")
    got = {r.id: r.restored for r in mojibake.repair_texts(df, "id", "text", "lang").where("garbled").collect()}
    assert got == {9000: "Le cœur bat plus vite."}
    assert mojibake.fit_model(df, "text", "lang")["known"] == {"clé": 3000, "crèche.": 3000, "cœur": 4}


def test_model_by_aggregations(spark, monkeypatch):
    """The aggregations give the model of all texts, with ties at the end of a dictionary and garbled, odd and repeated texts."""
    monkeypatch.setattr(mojibake, "DICT_BYTES", 600)
    monkeypatch.setattr(mojibake, "DICT_LANGS", 3)
    rng = random.Random(6)
    rows = [(" ".join(rng.choice(v) for _ in range(3)) + f" Nº {i} {letters_of(i * k)}", k_) for k, (k_, v) in enumerate(SENTENCES.items(), 1) for i in range(60)]
    rows += [("La rÃ©ponse arrive aprÃ¨s le dÃ®ner.\u2003 &eacute;t&#233; \ufffd", "fr"), ("été\u00a0\n\r\t１２ \x1c été;\x85fin été", "fr"), ("", "fr"), ("  ", None), (None, "de"), ("😀 naïve \u2028x", "xx"), ("n" * 700 + " é", "de")]
    rows += rows[:50] + [(rows[0][0], "it")] * 3
    df = spark.createDataFrame(rows, "text string, lang string")
    got, want = mojibake.fit_model(df, "text", "lang"), mojibake.sample_model(df, "text", "lang")
    assert got == want and len(got["dictionaries"]) == 4
    empty = mojibake.fit_model(df.limit(0), "text", "lang")
    assert empty == {"dictionaries": {}, "alphabet": frozenset(), "known": {}}


def test_lost(model):
    judge = mojibake.Judge(model)
    assert judge.repair("le d�ner")[1] == ["lost"]


def test_rows(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(v) for _ in range(5)), k) for k, v in SENTENCES.items() for i in range(30)]
    rows += [(1000, "La rÃ©ponse arrive aprÃ¨s le dÃ®ner.", "fr"), (1001, None, "fr"), (1002, "", None), (1003, "   ", "xx"), (1004, SENTENCES["de"][0] * 2000, "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumnRenamed("x", "chains")
    got = {r.doc_id: r for r in mojibake.repair_texts(df, "doc_id", "text", "lang").collect() if r.garbled}
    assert set(got) == {1000} and got[1000].restored == "La réponse arrive après le dîner."
    empty = mojibake.repair_texts(df.limit(0), "doc_id", "text", "lang")
    assert empty.count() == 0


def test_language_labels(spark):
    rows = spark.createDataFrame([(x,) for x in ("Polish", "Portuguese", "pt-BR", " PT ", "en_GB", "", None, "  ")], "lang string")
    got = [r[0] for r in rows.select(mojibake.fold_language(rows.lang)).collect()]
    assert got == ["polish", "portuguese", "pt", "pt", "en", "*", "*", "*"]


def test_more_languages_than_dictionaries(spark):
    """Texts of languages beyond ``SAMPLE_LANGS`` are repaired as well: those share a dictionary."""
    rows = []
    for k in range(70):
        large = k < 66
        for i in range(12 if large else 8):
            text = f"report {k} of the run number {i} in the hall" if large else f"það var góður dagur í þorpinu og allir fóru út að ganga, skýrsla {i} frá {k}"
            rows.append((len(rows), text, f"lang{k:02d}"))
    rows.append((1000, "það var góður dagur í þorpinu og allir fóru út að ganga, skýrsla 9".encode().decode("cp1252", "replace"), "lang69"))
    rows.append((1001, "allir fóru út að ganga í þorpinu".encode().decode("latin-1"), "lang69"))
    df = spark.createDataFrame(rows, "id long, text string, lang string")
    got = {r.id: r.restored for r in mojibake.repair_texts(df, "id", "text", "lang").where("garbled").collect()}
    assert set(got) == {1000, 1001} and got[1001] == "allir fóru út að ganga í þorpinu"
