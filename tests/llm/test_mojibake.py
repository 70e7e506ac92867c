"""Restoration of texts garbled on purpose, and texts that must stay as they are."""

from __future__ import annotations

import random

import pyarrow.parquet as pq
import pytest

from tickloom.llm import mojibake

PATH = "/root/testdata/sf0.01/documents.parquet"
CHAINS = [("cp1252", "utf-8", "fr"), ("cp1251", "utf-8", "el"), ("mac_roman", "utf-8", "de"), ("cp437", "utf-8", "ru"), ("cp1252", "cp1251", "ru"), ("cp1252", "cp1250", "pl"), ("cp1252", "cp1254", "tr"), ("cp1252", "cp1253", "el"), ("mac_roman", "cp932", "ja"), ("cp1251", "cp1252", "de"), ("koi8-r", "cp1251", "ru")]


@pytest.fixture(scope="module")
def model(spark):
    return mojibake.fit(spark.read.parquet(PATH))


@pytest.fixture(scope="module")
def restorer(model):
    return mojibake.Restorer(model)


@pytest.fixture(scope="module")
def clean(restorer):
    """Texts in which nothing is found, by language."""
    out = {}
    for r in pq.read_table(PATH).to_pylist():
        if r["text"] and r["lang"] and r["lang"].islower() and restorer.restore(r["text"], r["lang"])[2] == 0 and restorer.detect(r["text"]) == r["lang"]:
            out.setdefault(r["lang"], []).append(r["text"])
    return out


def garbled(text, wrong, right):
    """As if bytes of the right codec had been read with the wrong one; undefined bytes become controls."""
    try:
        raw = text.encode(right)
    except UnicodeEncodeError:
        return None
    return "".join(bytes([b]).decode(wrong, "ignore") or chr(b) for b in raw)


@pytest.mark.parametrize(("wrong", "right", "lang"), CHAINS)
def test_whole_documents_come_back(restorer, clean, wrong, right, lang):
    tried = found = exact = 0
    for text in clean[lang][:25]:
        bad = garbled(text, wrong, right)
        if bad is None or sum(a != b for a, b in zip(bad, text, strict=False)) < 20:
            continue
        done, _, lines = restorer.restore(bad, lang)
        tried += 1
        found += lines > 0
        exact += sum(a == b for a, b in zip(done.split("\n"), text.split("\n"), strict=False)) >= 0.9 * (text.count("\n") + 1)
    assert tried >= 3 and found == tried and exact >= 0.8 * tried


def test_single_lines(restorer, clean):
    rng, found, tried = random.Random(1), 0, 0
    for text in clean["fr"][:40]:
        lines = text.split("\n")
        marked = [i for i, x in enumerate(lines) if len(x) > 15 and not x.isascii()]
        if marked:
            i = rng.choice(marked)
            bad = lines.copy()
            bad[i] = garbled(lines[i], "cp1252", "utf-8") or lines[i]
            if bad != lines:
                tried += 1
                found += restorer.restore("\n".join(bad), "fr")[0] == text
    assert tried > 10 and found >= 0.9 * tried


def test_twice_garbled(restorer):
    text = "Évidemment, la fenêtre reste ouverte à côté du château."
    bad = garbled(garbled(text, "cp1252", "utf-8"), "cp1252", "utf-8")
    assert restorer.restore(bad, "fr")[:2] == (text, ["utf-8<cp1252 utf-8<cp1252"])


@pytest.mark.parametrize("line", ["№ 7, ½ cup, 3 × 4 µm", "It was −30 °C out there.", "SENÃO, MAMÃ!", "ÂGE: 40. À BIENTÔT.", "Ðorða Þing", "═══ releases ═══", "© captioning • x.example", "naıve — or naïve?", "АВС or ABC?", "It cost 40 € ± 5 %, § 12.", "¶ ¶ And the river ran ¶", "😀 👍", "café", "&eacute;", "░▒▓"])
def test_unusual_but_right(restorer, line):
    for lang in ("en", "pl", "ru", None):
        assert restorer.restore(f"1\n{line}\n", lang) == (f"1\n{line}\n", [], 0)


def test_operator(spark, model):
    bad = garbled("Ça fait longtemps que le théâtre est fermé.", "cp1252", "utf-8")
    rows = [(1, None, "fr"), (2, "", "fr"), (3, bad, "fr"), (3, bad, "FR"), (4, bad, None), (None, "plain", "xx"), (5, "K�nnen", "de"), (6, bad + "\r\n" + "x " * 100_000, "fr")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    made = mojibake.restored(frame, model).collect()
    assert len(made) == len(rows) and {r["doc_id"] for r in made if r["garbled_lines"]} == {3, 4, 5, 6}
    assert all(r["text"] == "Ça fait longtemps que le théâtre est fermé." for r in made if r["doc_id"] in (3, 4))
    assert next(r["text"] for r in made if r["doc_id"] == 1) is None
    assert mojibake.restored(frame.limit(0)).collect() == []


def corpus():
    """Documents of the table without the ones that hold marks of UTF-8 read wrongly or lost characters."""
    marks = ("Ã", "Â", "â€", "Ð", "Ñ", "Å", "Ä", "�", "\x80", "\x99")
    return [r for r in pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "text", "lang"]).to_pylist() if r["text"] and r["lang"] and not any(x in r["text"] for x in marks)]


@pytest.mark.parametrize("rate", [0.02, 0.2, 0.5])
def test_any_rate_of_garbling(spark, rate):
    """Found, and not found elsewhere, for at least nine in ten, whatever the share of garbled documents; also with 20 documents of a language."""
    chains = {"fr": ("cp1252", "utf-8"), "pl": ("cp1252", "cp1250"), "ru": ("cp1252", "cp1251"), "is": ("cp1252", "utf-8")}
    rng, rows, wanted, few, seen = random.Random(11), [], {}, 0, 0
    for r in corpus():
        lang = r["lang"].strip().lower()
        if lang not in (*chains, "en", "de"):
            continue
        few += lang == "is"
        seen += 1
        if lang == "is" and few > 20 or lang not in ("is", "fr") and seen % 3:
            continue
        text = r["text"]
        if lang in chains and not text.isascii() and rng.random() < rate:
            lines = [garbled(x, *chains[lang]) for x in text.split("\n")]
            bad = "\n".join(y if x is None else x for x, y in zip(lines, text.split("\n"), strict=True))
            if bad != text:
                wanted[r["doc_id"]] = text
                text = bad
        rows.append((r["doc_id"], text, r["lang"]))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    base = {r["doc_id"] for r in mojibake.restored(spark.createDataFrame([(k, wanted.get(k, t), g) for k, t, g in rows], frame.schema)).where("garbled_lines > 0").collect()}
    made = {r["doc_id"]: r["text"] for r in mojibake.restored(frame).where("garbled_lines > 0").collect()}
    hits = sum(k in made for k in wanted)
    wrong = sum(k not in wanted and k not in base for k in made)  # the table's own garbled documents are found either way
    exact = sum(made.get(k) == v for k, v in wanted.items() if k not in base)
    print(f"rate {rate}: {len(wanted)} garbled, {hits} found, {wrong} wrongly, {exact} of {len(set(wanted) - base)} restored exactly")
    assert hits >= 0.9 * len(wanted) and wrong <= 0.1 * max(10, len(made))
    assert exact >= 0.6 * len(set(wanted) - base)


def test_long_texts_are_sampled():
    text = "\n".join(f"ligne {i} été" for i in range(20_000)) + "\n" + "é" * 5_000
    part = mojibake._sampled_lines(text)
    assert 2_000 < sum(map(len, part)) < 20_000 and max(map(len, part)) <= mojibake.PIECE
    assert mojibake._sampled_lines("a\nb") == ["a", "b"]


@pytest.mark.parametrize(("wrong", "right", "lang", "first", "name", "text"), [
    ("cp1251", "cp866", "ru", "Повторяю: мельница пуста прошлой осенью.", "Véri... ", "Если честно, дверь"),
    ("cp1253", "cp737", "el", "Νόμιζα ότι ο σκύλος γύρισε", "Likaé, ", "Ποιος είναι;"),
    ("cp1252", "cp1251", "ru", "Я никогда не говорил, что ключ", "Momo\x85 ", "Я слышал, что письмо"),
])
def test_foreign_word_in_a_line(restorer, wrong, right, lang, first, name, text):
    bad = f"{garbled(first, wrong, right)}\n{name}{garbled(text, wrong, right)}"
    done = restorer.restore(bad, lang)[0].split("\n")
    assert done[0] == first and done[1].endswith(text)


def test_usual_characters(restorer):
    line = "Если честно, собака нашла след без единого слова."
    bad = garbled(line.lower(), "koi8-r", "cp1251")  # only letters of the language
    assert restorer.restore(bad, "ru")[0] == line.lower()


def test_alphabet_without_copies_and_garbled_texts(spark):
    rows = [(r["doc_id"], r["text"], "fr") for r in pq.read_table(PATH).to_pylist() if r["lang"] == "fr" and r["text"]]
    bad = garbled("Évidemment, la fenêtre reste ouverte à côté du château.", "cp1252", "utf-8")
    many = [(10_000 + i, f"{bad}\n{i}", "fr") for i in range(len(rows) // 3)]  # distinct texts
    copies = [(20_000 + i, "Straße", "fr") for i in range(len(rows) // 3)]
    made = mojibake.fit(spark.createDataFrame(rows + many + copies, "doc_id bigint, text string, lang string"))
    assert not set("Ã©ß") & set(made.usual["fr"]) and "é" in made.usual["fr"]
    assert mojibake.Restorer(made).restore(many[0][1], "fr")[0].startswith("Évidemment, la fenêtre")


def test_all_texts_and_lines_are_learnt_from(spark):
    """More texts than were once sampled for a language, and one long text: the dictionaries, into which all fit, have nearly all their
    lines but for some that the trainer leaves out at its segments' ends; half and a quarter would be there of a sample."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(14))
    many, long = [word() for _ in range(1_200)], [word() for _ in range(1_500)]
    rows = [(i, f"é {x}\n{x} été là", "fr") for i, x in enumerate(many)] + [(5_000, "\n".join(f"là {x} é" for x in long), "de")]
    assert len(rows[-1][1]) > 3 * mojibake.SAMPLE_CHARS
    made = mojibake.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    for lang, words in (("fr", many), ("de", long)):
        assert sum(x.encode() in made.dictionaries[lang] for x in words) >= 0.75 * len(words)


def test_garbled_words_are_told_by_all_texts(spark):
    """A rare word read with a wrong codec is told by the one text of many that has it right."""
    swapped, utf8 = garbled("théâtre", "cp1252", "mac_roman"), garbled("château", "cp1252", "utf-8")
    texts = ["à côté"] * 2_000 + ["théâtre\nthéâtre", swapped, utf8]
    bad = mojibake._garbled_words(spark.createDataFrame([("fr", x) for x in texts], "k string, words string"))
    assert swapped in bad["fr"] and utf8 in bad["fr"]
    assert not {"théâtre", "côté", "à"} & bad["fr"]


def test_dictionaries_of_parts_are_merged(spark, monkeypatch):
    monkeypatch.setattr(mojibake, "PART_BYTES", 30_000)
    monkeypatch.setattr(mojibake, "MERGED_PARTS", 2)
    made = mojibake.fit(spark.read.parquet(PATH))
    assert set(made.dictionaries) == set(made.usual) and max(map(len, made.dictionaries.values())) <= mojibake.DICTIONARY_BYTES
    text = "Évidemment, la fenêtre reste ouverte à côté du château."
    assert mojibake.Restorer(made).restore(garbled(text, "cp1252", "utf-8"), "fr")[0] == text


def test_right_lines_are_passed_over_uncompressed(model, clean, monkeypatch):
    """Most lines of a language's own characters have no candidate, and cost no compression to see that."""
    fresh, sized = mojibake.Restorer(model), []
    length = mojibake.Restorer.length
    monkeypatch.setattr(mojibake.Restorer, "length", lambda self, text, langs, *more: sized.append(text) or length(self, text, langs, *more))
    lines = {(x, lang) for lang in ("ru", "el", "cs", "fr") for t in clean[lang][:20] for x in t.split("\n") if not x.isascii() and not fresh.odd(x, (lang,))}
    for line, lang in sorted(lines):
        assert fresh.best(line, (lang,), frozenset())[0] == line
    assert len(lines) > 500 and len(sized) < 0.3 * len(lines)


def test_no_candidate_is_passed_over(restorer, clean):
    """The candidates of multi-byte codecs, of which words are tried once, are all that whole lines and their words have."""
    seen = 0
    for wrong, right, lang in [*CHAINS, ("cp1252", "euc_jp", "ja"), ("latin-1", "cp932", "ja")]:
        for text in clean[lang][:6]:
            for x in text.split("\n"):
                for line in (x, garbled(x, wrong, right), f"{garbled(x, wrong, right)} Véri — {x}"):
                    if not line or line.isascii():
                        continue
                    here, langs = "".join(mojibake._HIGHS.findall(line)), (lang,)
                    odd, mixed = restorer.odd_count(line, langs), len(mojibake._MIXED.findall(line))
                    paired = mojibake._holds_utf8(line)
                    made = {c for c in restorer._cheaper(line, here, frozenset(here), langs, odd, mixed > 0, paired, [1e12]) if c[2][1] in mojibake._MULTI}
                    assert made == {c for c in restorer.candidates(line) if c[2][1] in mojibake._MULTI}
                    seen += len(made)
    assert seen > 1_000


def test_lines_that_come_again_are_kept(model, monkeypatch):
    monkeypatch.setattr(mojibake, "KEPT_LINES", 10)
    fresh, tried = mojibake.Restorer(model), []
    best = mojibake.Restorer.best
    monkeypatch.setattr(mojibake.Restorer, "best", lambda self, *x: tried.append(x[0]) or best(self, *x))
    for i in range(100):
        assert fresh.restore(f"été {i}\r\nété\n", "fr") == (f"été {i}\r\nété\n", [], 0)
    assert tried.count("été") == 1 and len(fresh.lines["fr",]) <= 10
