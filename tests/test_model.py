"""Declarations: what is refused, and layers drawn from dependencies."""

import pytest

from swarmframe import errors as E
from swarmframe.model import Birth, Emit, Function, Message, Model, Read, SubModel
from swarmframe.operators.shapes import Space
from swarmframe.plans.dag import DependencyGraph, Node
from swarmframe.types import Variable


@pytest.fixture
def model():
    m = Model("m")
    m.agent("a").variable("x", "int64").state("s").state("t")
    m.agent("b").variable("x", "int64")
    m.message("all").variable("x", "int64")
    return m


@pytest.mark.parametrize("name", ["_x", "", "name", "State", "_auto_sort_bin_index"])
def test_reserved_names(model, name):
    with pytest.raises(E.ModelError):
        model.agents["a"].variable(name)


def test_twice(model):
    for act in (lambda: model.agent("a"), lambda: model.agents["a"].variable("x"), lambda: model.agents["a"].state("s"), lambda: model.message("all"), lambda: model.messages["all"].variable("x")):
        with pytest.raises(E.ModelError):
            act()


@pytest.mark.parametrize("kind, value", [("uint8", -1), ("uint8", 256), ("int8", 128), ("int32", 2**31), ("uint64", 2**64), ("int64", 1.5e400)])
def test_values_out_of_range(kind, value):
    with pytest.raises((E.ModelError, OverflowError)):
        Variable("v", kind).check(value)


def test_array_variables():
    assert Variable("v", "int32", 3).initial == [0, 0, 0]
    with pytest.raises(E.ModelError):
        Variable("v", "int32", 3, [1, 2])
    with pytest.raises(E.ModelError):
        Variable("v", "int32", 3).check([1])


@pytest.mark.parametrize("spec", [dict(shape="bucket"), dict(shape="bucket", bounds=(3, 3)), dict(shape="space"), dict(shape="grid"), dict(shape="grid", size=(0,)), dict(shape="grid", size=(1, 1, 1, 1)), dict(shape="what")])
def test_bad_messages(spec):
    with pytest.raises(E.MessageError):
        Message("m", **spec)


@pytest.mark.parametrize("low, high, r", [((0,), (1,), 1), ((0, 0), (1, 1), 0), ((0, 0), (0, 1), 1), ((0, 0), (1, 1, 1), 1)])
def test_bad_spaces(low, high, r):
    with pytest.raises(E.MessageError):
        Space(low, high, r)


@pytest.mark.parametrize("one, two", [
    (Function("f", "a", initial="s"), Function("f", "a", initial="t")),
    (Function("f", "a", initial="s"), Function("g", "a", initial="t", end="s")),
    (Function("f", "b", birth=Birth("a", {}, "s")), Function("g", "a", initial="s")),
    (Function("f", "a", emit=Emit("all", {"x": "x"})), Function("g", "b", emit=Emit("all", {"x": "x"}))),
    (Function("f", "a", emit=Emit("all", {"x": "x"})), Function("g", "b", read=Read("all", {"n": "count(1)"}))),
])
def test_layer_conflicts(model, one, two):
    with pytest.raises(E.LayerError):
        model.layer(one, two)
    with pytest.raises(E.LayerError):
        model.layer(two, one)


def test_layers_of_one_kind(model):
    with pytest.raises(E.LayerError):
        model.layer(Function("f", "a"), host=lambda w: None)


@pytest.mark.parametrize("f", [
    Function("f", "no"), Function("f", "a", initial="no"), Function("f", "a", alive="false"), Function("f", "a", emit=Emit("all", {"y": "1"})),
    Function("f", "a", read=Read("no", {})), Function("f", "a", birth=Birth("b", {"y": "1"})), Function("f", "a", birth=Birth("b", {}, "no")),
    Function("f", "a", read=Read("all", {}), emit=Emit("all", {"x": "1"})),
])
def test_bad_functions(model, f):
    with pytest.raises(E.SwarmError):
        model.layer(f)


def test_submodels(model):
    inner = Model("inner")
    inner.agent("p").variable("x", "double")
    with pytest.raises(E.ModelError):  # no end
        model.submodel("s", inner)
    with pytest.raises(E.ModelError):  # another type
        model.submodel("s", inner, agents={"p": "a"}, variables={"p": {"x": "x"}}, max_steps=1)
    with pytest.raises(E.ModelError):
        model.submodel("s", model, max_steps=1)
    outer = Model("outer")
    outer.submodel("s", model, max_steps=1)
    with pytest.raises(E.ModelError):
        model.submodel("t", outer, max_steps=1)
    assert isinstance(outer.submodels["s"], SubModel)


def test_dependencies(model):
    f, g, h = (Node(Function(n, "a", initial="s")) for n in "fgh")
    g.depends_on(f)
    h.depends_on(f)
    graph = DependencyGraph(f, g, h)
    assert [[x.name for x in layer.functions] for layer in graph.layers(model)] == [["f"], ["g"], ["h"]]  # g and h clash
    assert '"f" -> "g"' in graph.dot() and graph.text(model).startswith("layer 0: f")
    f.depends_on(h)
    with pytest.raises(E.LayerError):
        graph.layers(model)
    with pytest.raises(E.LayerError):
        DependencyGraph(Node(Function("x", "a")).depends_on(Node(Function("y", "b")))).depths()


def test_macro_reads_and_updates_do_not_mix(model):
    from swarmframe.model import MacroUpdate

    model.environment.macro("m", "double", (3,))
    add = MacroUpdate("m", "add", {"i": "0"}, "1")
    look = Read(macro="m", fold={"v": "value"})
    with pytest.raises(E.LayerError):
        model.layer(Function("f", "a", read=look, macro=add))
    with pytest.raises(E.LayerError):
        model.layer(Function("f", "a", macro=add), Function("g", "b", read=look))
    for bad in (Read(macro="no", fold={"v": "value"}), Read(macro="m"), Read(graph="no", key="x")):
        with pytest.raises(E.EnvironmentError_):
            model.layer(Function("f", "a", read=bad))
    for size in ((0,), (1, 1, 1, 1, 1)):
        with pytest.raises(E.EnvironmentError_):
            model.environment.macro("n", "double", size)
