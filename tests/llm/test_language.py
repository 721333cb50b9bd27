import numpy as np

import corpus_pipeline
from ridelens.llm import language
from ridelens.llm.common import table
from tests.conftest import SF001
from tests.llm.helpers import docs, hard_rows


def test_held_out_accuracy(spark):
    rows = table(spark, SF001, "documents")
    found = language.identify(rows, language.train(rows.filter(~language.held_out())))
    got = found.join(rows.select("doc_id", "lang"), "doc_id").filter(language.held_out()).collect()
    assert len(got) > 250
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_score_is_the_cosine_of_bound_and_bundled_vectors():
    e = language.Encoder()
    text = "Été 1 abc"
    letters = " été abc "
    number = {c: e._letter_number(c) for c in letters}
    place = {c: e._letters[n].astype(float) for c, n in number.items()}
    want = sum(
        np.roll(place[letters[i]], 2) * np.roll(place[letters[i + 1]], 1) * place[letters[i + 2]] for i in range(len(letters) - 2)
    )
    assert np.array_equal(e.vectors([text])[0], want)


def test_blocks_do_not_change_vectors():
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdéß日本"), 5)) for _ in range(4000)]
    many = [" ".join(words[i : i + 40]) for i in range(0, 4000, 40)]
    assert np.array_equal(language.Encoder().vectors(many), np.stack([language.Encoder().vectors([t])[0] for t in many]))


def test_hard_rows(spark):
    model = {"en": list(language.Encoder().vectors(["one text with words"])[0].astype(float))}
    got = {(r.doc_id, r.lang_pred) for r in language.identify(docs(spark, [*hard_rows(), (8, "12 ?")]), model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (8, "und"), (4, "en"), (None, "en")} <= got
    kept = language.keep_known(docs(spark, hard_rows()), model, 0.0)
    assert kept.columns == docs(spark, []).columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 4, 4, 5, 6]


def test_nothing_to_learn_from(spark):
    empty = docs(spark, [])
    assert language.train(empty) == {}
    got = language.identify(docs(spark, [(1, "abc")]), {}).collect()
    assert (got[0].lang_pred, got[0].score) == ("und", 0.0)
    assert language.identify(empty, {}).collect() == []


UNLEARNED = [
    "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza.",
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler.",
    "सभी मनुष्यों को गौरव और अधिकारों के मामले में जन्मजात स्वतन्त्रता और समानता प्राप्त है। उन्हें बुद्धि और अन्तरात्मा की देन प्राप्त है।",
    "모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다. 인간은 천부적으로 이성과 양심을 부여받았으며 서로 형제애의 정신으로 행동하여야 한다.",
    "يولد جميع الناس أحراراً متساوين في الكرامة والحقوق. وقد وهبوا عقلاً وضميراً وعليهم أن يعامل بعضهم بعضاً بروح الإخاء.",
]


def test_pipeline_keeps_only_languages_it_learned(spark):
    rows = table(spark, SF001, "documents")
    rng = np.random.default_rng(3)
    scripts = [(0x3B1, 0x3CA), (0xAC00, 0xD7A3), (0x4E00, 0x9FA5)]
    noise = [" ".join("".join(map(chr, rng.integers(*scripts[i % 3], 5))) for _ in range(n)) for i, n in enumerate([30] * 30 + [200] * 30)]
    learned = ["Hello.", "The house.", "All human beings are born free and equal in dignity and rights.", "the " * 300]
    strange = rows.sparkSession.createDataFrame([(-1 - i, t) for i, t in enumerate(UNLEARNED + noise + learned)], "doc_id long, text string")
    every = rows.unionByName(strange, allowMissingColumns=True)
    kept = {r.doc_id for r in corpus_pipeline.known_language(spark, every, SF001).select("doc_id").collect()}
    unlearned = len(UNLEARNED) + len(noise)
    assert {x for x in kept if x < 0} == {-1 - unlearned - i for i in range(len(learned))}
    assert kept >= {r.doc_id for r in rows.filter("text rlike '[a-z]'").select("doc_id").collect()}
