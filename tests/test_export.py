"""The ontology of the test wiki, parsed: order, demands, kinds, values."""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pytest
from test_operators import WIKI

from veracity.plans import export_owl
from veracity.sources import wiki_xml

RDF, RDFS, OWL = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}", "{http://www.w3.org/2000/01/rdf-schema#}", "{http://www.w3.org/2002/07/owl#}"
REL = "{http://localhost/kb/relation/}"
short = lambda iri: iri.rsplit("/", 1)[-1].rsplit("#", 1)[-1]


@pytest.fixture(scope="module")
def state(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("wiki") / "dump.xml"
    path.write_text(WIKI.replace("[[Is inverse of::Property:Bears]]", "[[Is inverse of::Property:Bears]] [[Category:Transitive properties]]"))
    return wiki_xml.load(spark, str(path))


def parsed(spark, state, **more):
    return ET.fromstring("".join(r.text for r in export_owl.export(spark, *state, **more).orderBy("section", "key").collect()))


def test_classes_come_after_a_parent(spark, state):
    got = [(short(c.get(RDF + "about")), sorted(short(s.get(RDF + "resource")) for s in c.findall(RDFS + "subClassOf"))) for c in parsed(spark, state).findall(OWL + "Class") if c.find(RDFS + "label") is not None]
    assert got == [("Day", ["Night"]), ("Night", ["Day"]), ("Harvest", ["Thing"]), ("Plant", ["Thing"]), ("Tree", ["Plant", "Timber"]), ("Timber", ["Thing"])]


def test_demands(spark, state):
    found = set()
    for c in parsed(spark, state).findall(OWL + "Class"):
        for r in c.findall(f"{RDFS}subClassOf/{OWL}Restriction"):
            what = next(x for x in r if x.tag != OWL + "onProperty")
            found.add((short(c.get(RDF + "about")), short(r.find(OWL + "onProperty").get(RDF + "resource")), short(what.tag.replace(OWL, "")), what.text or short(what.get(RDF + "resource"))))
    assert found == {
        ("Plant", "Bears", "allValuesFrom", "Harvest"), ("Plant", "Bears", "minCardinality", "1"), ("Plant", "Bears", "maxCardinality", "2"),
        ("Tree", "Bears_early", "allValuesFrom", "Timber"), ("Tree", "Bears_early", "minCardinality", "1"), ("Tree", "Bears_early", "maxCardinality", "3"),
        ("Tree", "Height", "allValuesFrom", "string"), ("Plant", "Yield", "allValuesFrom", "string"), ("Harvest", "Borne_by", "allValuesFrom", "Timber"),
    }


def test_properties(spark, state):
    tree = parsed(spark, state)
    of = {short(p.get(RDF + "about")): p for p in tree.findall(OWL + "ObjectProperty")}
    assert set(of) == {"Bears", "Bears_early", "Borne_by"} and {short(p.get(RDF + "about")) for p in tree.findall(OWL + "DatatypeProperty")} == {"Height", "Yield"}
    assert short(of["Bears_early"].find(RDFS + "subPropertyOf").get(RDF + "resource")) == "Bears"
    assert short(of["Borne_by"].find(OWL + "inverseOf").get(RDF + "resource")) == "Bears" and short(of["Borne_by"].find(RDF + "type").get(RDF + "resource")) == "TransitiveProperty"
    rdfs = {short(p.get(RDF + "about")): p for p in parsed(spark, state, rdfs=True).findall(OWL + "ObjectProperty")}
    assert short(rdfs["Bears"].find(RDFS + "domain").get(RDF + "resource")) == "Plant" and short(rdfs["Bears"].find(RDFS + "range").get(RDF + "resource")) == "Harvest"


def test_individuals(spark, state):
    of = {short(i.get(RDF + "about")): i for i in parsed(spark, state).findall(OWL + "Thing")}
    assert set(of) == {"Elder", "Thyme", "Oak", "Drupe", "Dusk"}
    heights = of["Elder"].findall(REL + "Height")
    assert [(h.text, short(h.get(RDF + "datatype"))) for h in heights] == [("4.0", "float")]  # feet are unknown
    assert sorted(short(b.get(RDF + "resource")) for b in of["Elder"].findall(REL + "Bears")) == ["Drupe"]
    assert [short(s.get(RDF + "resource")) for s in of["Drupe"].findall(OWL + "sameAs")] == ["Old_drupe"]
    assert [t.text for t in of["Elder"].findall(REL + "Yield")] == ["2020; 3; 4"]


def test_written_files_keep_the_order(spark, state, tmp_path):
    export_owl.write(export_owl.export(spark, *state), f"file://{tmp_path}/owl")
    text = "".join(p.read_text() for p in sorted((tmp_path / "owl").glob("part-*")))
    assert ET.fromstring(text.replace("\n", "")).tag == RDF + "RDF"
