import numpy as np
import pytest

from minuteworks.llm import language as L

BASE = {
    "de": "Die Verwaltung sagt zu, die Ergebnisse dem Protokoll beizufügen. Der Ausschuss nimmt den Bericht zur Kenntnis. Eine Bürgerin übergibt eine Liste mit Unterschriften. Das Rechtsamt hält die Formulierung für zulässig. Mehrere Mitglieder mahnen an, früher zu planen.",
    "en": "The committee takes note of the report on the school. Citizens may send their comments until spring. The costs have risen since the first estimate was presented. The chair states that the body has a quorum. Families who need help can visit the desk.",
    "fr": "La commission prend acte du rapport sur l'école. Les habitants peuvent envoyer leurs remarques. Les coûts ont augmenté depuis la première estimation. La présidence constate que le quorum est atteint. Les familles peuvent venir au guichet.",
    "nl": "De commissie neemt kennis van het verslag over de school. Inwoners kunnen hun opmerkingen insturen. De kosten zijn gestegen sinds de eerste raming. De voorzitter stelt vast dat er genoeg leden zijn. Gezinnen kunnen terecht bij het loket.",
    "tr": "Komisyon okul hakkındaki raporu bilgi olarak almıştır. Vatandaşlar görüşlerini yazılı olarak bildirebilir. Maliyetler ilk tahminden beri artmıştır. Başkan yeterli üyenin bulunduğunu belirtiyor. Aileler danışma masasına gelebilir.",
}


@pytest.fixture(scope="module")
def tagger():
    return L.train([(k, v) for k, v in BASE.items()] * 12, epochs=5)


def test_kinds(spark, tagger):
    rows = [
        (1, BASE["de"], "de"), (2, BASE["de"], None), (3, BASE["fr"], "de"), (4, BASE["tr"], "xx"), (5, BASE["de"] + "\n\n" + BASE["en"], "de"), (6, "kurz", "fr"), (7, None, "de"), (8, "", None),
        (9, BASE["nl"], "nl-NL"), (10, BASE["de"] + " Als Motto dient „Let us move together“.", "Deutsch"), (11, BASE["en"].upper(), " EN "), (12, BASE["de"] * 300, "german"), (13, BASE["de"], "pl"), (14, "123 456", "de"), (14, "123 456", "de"),
    ]
    got = {r["id"]: r for r in L.detect(spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, lang string, kind string"), tagger).collect()}
    kinds = {i: (r["kind"], r["lang"]) for i, r in got.items()}
    assert kinds[1] == ("right", "de") and kinds[2] == ("missing", "de") and kinds[3] == ("wrong", "fr") and kinds[4] == ("missing", "tr")
    assert kinds[5][0] == "mixed" and set(got[5]["langs"]) == {"de", "en"} and [p["lang"] for p in got[5]["passages"]] == ["de", "en"]
    assert kinds[6][0] is None and kinds[7] == (None, None) and kinds[8] == (None, None) and kinds[14] == (None, None)
    assert kinds[9] == ("right", "nl") and kinds[10] == ("right", "de") and kinds[11] == ("right", "en") and kinds[12] == ("right", "de") and kinds[13] == ("wrong", "de")
    assert L.detect(spark.createDataFrame([], "doc_id long, text string, lang string"), tagger).count() == 0


def test_forward_backward_matches_enumeration():
    import itertools

    rng = np.random.default_rng(0)
    s, t = rng.standard_normal((4, 3)), rng.standard_normal((3, 3))
    weight = {p: np.exp(sum(s[i, k] for i, k in enumerate(p)) + sum(t[a, b] for a, b in itertools.pairwise(p))) for p in itertools.product(range(3), repeat=4)}
    z = sum(weight.values())
    want = np.array([[sum(w for p, w in weight.items() if p[i] == k) / z for k in range(3)] for i in range(4)])
    padded = np.zeros((2, 6, 3))
    padded[0, :4], padded[1] = s, rng.standard_normal((6, 3))
    got, _ = L.forward_backward(padded, np.array([4, 6]), t)
    assert np.allclose(got[0, :4], want)


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").where("lang in ('de', 'en', 'fr', 'nl', 'tr') and length(text) between 200 and 3000")
    fit, rest = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    tagger = L.train_on(fit, rows_per_language=60)
    got = L.detect(rest, tagger).where("kind <> 'mixed'").selectExpr("avg(cast(label_lang = lang as double)) as a").first()["a"]
    assert got > 0.9  # some labels are wrong


def test_sums_are_added_in_order():
    """To the bit what adding row by row gives."""
    rng = np.random.default_rng(2)
    at, rows = rng.integers(7, size=900), rng.normal(size=(900, 5)) * 10.0 ** rng.integers(-9, 9, (900, 5))
    wanted = np.zeros((8, 5))
    np.add.at(wanted, at, rows)
    assert (L.sums(at, rows, 8) == wanted).all()
