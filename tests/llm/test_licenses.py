import re

from llm.cases import DOCUMENTS, documents, empty
from weftmine.llm import licenses



def filled(label, opt=True, holder="some holder"):
    """A template's text with its optional regions or without them, and something for the replaceable ones."""
    text = lambda parts: " ".join(p if isinstance(p, str) else holder if p[0] == "var" else text(p[1]) if opt else "" for p in parts)
    return " ".join(text(licenses.parsed(licenses.TEMPLATES[label])).split())


NOTICES = [
    "Prose.\nReleased under the MIT License.",
    "Licensed under CC BY-NC 4.0.",
    "This work is licensed under the GNU General Public License, version 3.",
    "Licensed under the Apache License, Version 2.0. Licensed under CC BY 4.0 MIT license gnu General public license",
    "Licensed under the GNU General Public License as published by the Free Software Foundation, version 3, or any later version",
    "Licensed under the GNU General Public License as published by others, version 3",
    "licensing of gnu general publicity license, ccby, mitlicense, apache  license",
    "Copyright (c) 2020 A. Person and others. Licensed under the MIT license",
    "MIT LICENSE\n\n" + filled("mit-text").capitalize().replace(" ", "\n", 30),
    filled("mit-text").replace("publish", "print"),
    "é" * 10 + "mit license ümit license",
    "x " * 30000 + "mit license",
    None,
    "",
]


def plain(text):
    """Brute force over the phrases."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for i in range(len(words)):
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_places_are_those_of_all_words(spark):
    rows = licenses.scan(documents(spark, NOTICES)).collect()
    assert {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows} == {i: plain(t) for i, t in enumerate(NOTICES)}
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in rows)


def test_template_labels(spark):
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(documents(spark, NOTICES)).collect()}
    assert got[0] == ("mit,mit-notice", 1.0)
    assert got[1] == ("cc-by,cc-by-nc-4.0", 1.0)
    assert got[2] == ("gpl,gpl-3.0", 1.0)
    assert got[3] == ("apache,apache-2.0,cc-by,cc-by-4.0,gpl,mit", 1.0)
    assert got[4] == ("gpl,gpl-3.0", 1.0) and got[5][0] == "gpl" and 0.5 <= got[5][1] < 1
    assert got[7][0] == "mit,mit-holder" and got[8] == ("mit,mit-text", 1.0)
    assert got[9][0] == "" and 0.2 < got[9][1] < 1  # the words up to the one that differs
    assert got[12] == got[13] == ("", 0.0)


def test_whole_texts(spark):
    labels = list(licenses.TEMPLATES)
    rows = [filled(k, opt) for k in labels for opt in (True, False)] + [filled(k)[:-4] + "#" for k in labels]
    got = {r.doc_id: (r.labels.split(","), r.score) for r in licenses.scan(documents(spark, rows, clash=False)).collect()}
    for i, label in enumerate(labels):
        assert all(label in got[2 * i + j][0] and got[2 * i + j][1] == 1 for j in (0, 1)), label
    assert not {"mit-text", "isc-text", "bsd-2-clause-text"} & {k for i in range(len(labels)) for k in got[2 * len(labels) + i][0]}
    assert "bsd-2-clause-text" not in got[2 * labels.index("bsd-3-clause-text")][0]
    assert got[2 * labels.index("creative-commons-by-sa")][0] == ["creative-commons-by-sa"]


def test_scores_ask_for_words_alone(spark):
    """What else a text holds doesn't change the score of the words in place."""
    rows = ["Released under the old regime.", "Released under the old regime, accordingly.", "Licensing accordingly: released under the old regime", "Nothing here."]
    got = {r.doc_id: r.score for r in licenses.scan(documents(spark, rows, clash=False)).collect()}
    assert got[0] == got[1] == got[2] > 0 == got[3]


def as_regex(template):
    marks = {"<<opt": "(?:", ">>": ")?"}
    tokens = re.findall(r"<<opt|<<var \d+>>|>>|[^\s<>]+", template)
    return re.compile("(?:^| )" + "".join(marks.get(t) or (f"(?:\\S+ ){{0,{t[6:-2]}}}" if t[0] == "<" else re.escape(t) + " ") for t in tokens))


def test_automata_take_what_regular_expressions_take():
    import random

    r = random.Random(4)
    templates = {"a": "licen one <<opt two three>> four", "b": "<<opt licen>> <<var 3>> cc five", "c": "licen <<var 2>> one <<opt six>>", "d": "one licen one licen two", "e": "licen <<opt one <<opt two <<var 1>> three>> four>> five", "f": "<<opt <<opt one>> two>> <<opt three>> six"}
    automata = licenses.Automata(templates)
    for _ in range(3000):
        words = [r.choice(["licen", "one", "two", "three", "four", "five", "cc", "six"]) for _ in range(r.randint(0, 12))]
        found, score = automata.scan([w.encode() for w in words])
        assert found == {k for k, t in templates.items() if as_regex(t).search("".join(w + " " for w in words))}
        assert (score == 1.0) == bool(found)


def test_empty_table_and_null_id(spark):
    assert licenses.scan(empty(spark)).collect() == []
    docs = spark.createDataFrame([(None, "mit license", None, None, None)], DOCUMENTS)
    assert licenses.scan(docs.union(docs)).count() == 2
