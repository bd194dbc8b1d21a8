from __future__ import annotations

import pytest

from docsieve import catalog as C
from docsieve.operators.prepass import BINDINGS, Binding, check_bindings


def test_registry():
    assert len(C.schemas()) == 12
    assert [s.name for s in C.schemas(True)] == ["conversation", "insurance_claim", "kg_triple"]
    assert sum(len(s.fields) for s in C.schemas()) == 106
    assert sum(len(s.paths("rule")) for s in C.schemas()) == 44
    with pytest.raises(KeyError, match="known: contract"):
        C.get_schema("nope")
    with pytest.raises(ValueError):
        C.register(C.get_schema("email"))
    with pytest.raises(ValueError):
        C.Schema("x", (C.Field("a", "str", "rule"), C.Field("a", "str", "model")))


def test_leaf_paths_of_struct_are_declared_paths():
    for s in C.schemas():
        assert C.leaf_paths(s.struct()) == s.paths()


def test_splits():
    assert C.split_schemas([], "eval") == ["conversation", "insurance_claim", "kg_triple"]
    assert len(C.split_schemas([], "train")) == 9
    with pytest.raises(ValueError, match="kg_triple"):
        C.split_schemas(["kg_triple"], "train")
    with pytest.raises(ValueError):
        C.split_schemas([], "test")


def test_bindings():
    assert sum(len(x) for x in BINDINGS.values()) == 37
    with pytest.raises(ValueError):
        Binding("dates", "after")
    with pytest.raises(ValueError):
        Binding("dates", "middle")
    with pytest.raises(ValueError):
        check_bindings({"email": {"subject": Binding("emails")}})


def test_dims(spark):
    assert C.field_dim(spark).count() == 106
    assert C.ontology_dim(spark).filter("schema = 'medical_note' and surface = 'htn'").count() == 1
