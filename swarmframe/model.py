"""What a model declares: agents, messages, environment, functions, layers, submodels.

Declarations are checked here and compiled in ``plans``. Expressions are SQL
text or Columns over the agent's variables; environment properties are read as
``env.<name>`` in SQL text, the step as ``env._step``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from .errors import EnvironmentError_, LayerError, MessageError, ModelError
from .operators.shapes import Fold, Space
from .types import Variable

DEFAULT_STATE = "default"
RESERVED = ("name", "state", "_auto_sort_bin_index")


def check_name(name: str, what: str) -> str:
    if not name or name.startswith("_"):
        raise ModelError(f"{what} {name!r}: names may not be empty or begin with an underscore")
    if what == "variable" and name.lower() in RESERVED:
        raise ModelError(f"variable {name!r}: the name is reserved")
    return name


@dataclass
class Agent:
    """A typed population, parted into states."""

    name: str
    variables: dict[str, Variable] = field(default_factory=dict)
    states: list[str] = field(default_factory=list)
    initial_state: str = ""
    sort_period: int = 1

    def variable(self, name: str, kind: str = "double", length: int = 0, default=None) -> Agent:
        check_name(name, "variable")
        if name in self.variables:
            raise ModelError(f"{self.name}: variable {name} is defined twice")
        self.variables[name] = Variable(name, kind, length, default)
        return self

    def state(self, name: str, initial: bool = False) -> Agent:
        if name in self.states:
            raise ModelError(f"{self.name}: state {name} is defined twice")
        self.states.append(name)
        if initial or not self.initial_state:
            self.initial_state = name
        return self

    @property
    def all_states(self) -> list[str]:
        return self.states or [DEFAULT_STATE]

    @property
    def first_state(self) -> str:
        return self.initial_state or DEFAULT_STATE

    def has_state(self, name: str) -> bool:
        return name in self.all_states

    def has_variable(self, name: str) -> bool:
        return name in self.variables

    def variable_kind(self, name: str) -> str:
        return self.variables[name].kind

    def variable_length(self, name: str) -> int:
        return max(1, self.variables[name].length)


@dataclass
class Message:
    """A message list. ``shape`` says who reads it: all, bucket, space or grid."""

    name: str
    variables: dict[str, Variable] = field(default_factory=dict)
    shape: str = "all"
    bounds: tuple[int, int] | None = None  # of bucket keys, both included
    space: Space | None = None
    size: tuple[int, ...] = ()  # of a grid
    persistent: bool = False

    def __post_init__(self) -> None:
        if self.shape not in ("all", "bucket", "space", "grid"):
            raise MessageError(f"{self.name}: unknown shape {self.shape}")
        if self.shape == "space" and self.space is None:
            raise MessageError(f"{self.name}: bounds and radius are not set")
        if self.shape == "bucket" and (self.bounds is None or self.bounds[0] >= self.bounds[1]):
            raise MessageError(f"{self.name}: bounds are not set or empty")
        if self.shape == "grid" and (not 1 <= len(self.size) <= 3 or min(self.size) < 1):
            raise MessageError(f"{self.name}: a grid has one to three dimensions of 1 or more")

    @property
    def keys(self) -> tuple[str, ...]:
        """Columns that an emitted message must have besides its variables."""
        return {"all": (), "bucket": ("_key",), "space": self.space.names if self.space else (), "grid": ("_ix", "_iy", "_iz")[: len(self.size)]}[self.shape]

    def variable(self, name: str, kind: str = "double", length: int = 0) -> Message:
        if name in self.variables:
            raise MessageError(f"{self.name}: variable {name} is defined twice")
        self.variables[check_name(name, "message variable")] = Variable(name, kind, length)
        return self


@dataclass(frozen=True)
class Property:
    name: str
    kind: str
    length: int
    value: object
    const: bool = False


@dataclass
class Environment:
    properties: dict[str, Property] = field(default_factory=dict)
    macros: dict[str, tuple[str, tuple[int, ...]]] = field(default_factory=dict)
    graphs: dict[str, tuple[dict[str, Variable], dict[str, Variable]]] = field(default_factory=dict)

    def property(self, name: str, value, kind: str = "double", const: bool = False) -> Environment:
        check_name(name, "property")
        if name in self.properties:
            raise EnvironmentError_(f"property {name} is defined twice")
        length = len(value) if isinstance(value, list | tuple) else 0
        self.properties[name] = Property(name, kind, length, Variable(name, kind, length).check(value), const)
        return self

    def macro(self, name: str, kind: str = "double", size: Sequence[int] = ()) -> Environment:
        if len(size) > 4 or any(n < 1 for n in size):
            raise EnvironmentError_(f"macro {name}: up to four dimensions of 1 or more")
        self.macros[check_name(name, "macro property")] = (kind, tuple(size))
        return self

    def graph(self, name: str, vertices: Sequence[Variable] = (), edges: Sequence[Variable] = ()) -> Environment:
        self.graphs[check_name(name, "graph")] = ({v.name: v for v in vertices}, {e.name: e for e in edges})
        return self


@dataclass(frozen=True)
class Read:
    """A message read: which list, how, and the fold over what is met.

    With ``graph`` it reads edges of the vertex ``key`` instead; with ``macro``
    the cell ``index`` of a macro property, under the fold's one name.
    """

    message: str = ""
    fold: Fold = field(default_factory=dict)
    key: str | None = None
    range: tuple[str, str] | None = None
    wrap: bool = False
    within: float | None = None
    reach: int = 1
    neumann: bool = False
    at: tuple[str, ...] = ()
    where: str | None = None
    defaults: dict | None = None
    graph: str | None = None
    incoming: bool = False
    macro: str | None = None
    index: dict[str, str] = field(default_factory=dict)
    parts: int = 1  # into so many the messages of a key, cell or vertex are dealt, where one holds a large share; 0: as a count finds

    @property
    def list_name(self) -> str | None:
        """The message list that is read, if any."""
        return self.message if self.graph is None and self.macro is None else None


@dataclass(frozen=True)
class Emit:
    """A message from each agent, or from those that meet ``when``."""

    message: str
    values: dict[str, object]
    when: object = None


@dataclass(frozen=True)
class Birth:
    agent: str
    values: dict[str, object]
    state: str | None = None
    when: object = True


MACRO_UPDATES = ("add", "subtract", "increment", "decrement", "min", "max", "exchange", "swap")


@dataclass(frozen=True)
class MacroUpdate:
    """How agents update a macro property: add, subtract, increment, decrement, min, max, exchange or swap.

    increment and decrement wrap around and are for uint32; swap writes ``value``
    where the cell holds ``expected``. ``result`` names an agent variable that
    gets what the agent found in the cell (of add, exchange and swap).
    """

    macro: str
    how: str
    index: dict[str, str]
    value: str = "1"
    expected: str | None = None
    result: str | None = None


@dataclass(frozen=True)
class Function:
    """An agent function: condition, read, variables set in order, death, message, birth, state."""

    name: str
    agent: str
    read: Read | None = None
    set: dict[str, object] = field(default_factory=dict)
    condition: object = None
    alive: object = None
    allow_death: bool = False
    emit: Emit | None = None
    birth: Birth | None = None
    macro: MacroUpdate | None = None
    initial: str | None = None
    end: str | None = None


@dataclass
class Layer:
    """Functions that see one snapshot, or one host function, or one submodel."""

    functions: list[Function] = field(default_factory=list)
    host: Callable | None = None
    submodel: SubModel | None = None


@dataclass
class SubModel:
    """A model run inside a layer of another; {own name: outer name} maps."""

    name: str
    model: Model
    agents: dict[str, str] = field(default_factory=dict)
    variables: dict[str, dict[str, str]] = field(default_factory=dict)
    states: dict[str, dict[str, str]] = field(default_factory=dict)
    properties: dict[str, str] = field(default_factory=dict)
    max_steps: int = 0


class Model:
    """The root: everything is declared on it, then ``validate`` is called by the compiler."""

    def __init__(self, name: str):
        self.name = name
        self.agents: dict[str, Agent] = {}
        self.messages: dict[str, Message] = {}
        self.environment = Environment()
        self.layers: list[Layer] = []
        self.submodels: dict[str, SubModel] = {}
        self.init: list[Callable] = []
        self.step: list[Callable] = []
        self.exit: list[Callable] = []
        self.exit_conditions: list[Callable] = []

    def agent(self, name: str) -> Agent:
        if name in self.agents:
            raise ModelError(f"agent {name} is defined twice")
        self.agents[name] = Agent(check_name(name, "agent"))
        return self.agents[name]

    def message(self, name: str, **shape) -> Message:
        if name in self.messages:
            raise MessageError(f"message {name} is defined twice")
        self.messages[name] = Message(check_name(name, "message"), **shape)
        return self.messages[name]

    def layer(self, *functions: Function, host: Callable | None = None, submodel: SubModel | None = None) -> Layer:
        found = Layer(list(functions), host, submodel)
        check_layer(self, found)
        self.layers.append(found)
        return found

    def submodel(self, name: str, model: Model, **maps) -> SubModel:
        if model is self or self in nested(model):
            raise ModelError(f"submodel {name}: a model cannot hold itself")
        sub = SubModel(name, model, **maps)
        check_submodel(self, sub)
        self.submodels[name] = sub
        return sub

    def functions(self) -> list[Function]:
        return [f for layer in self.layers for f in layer.functions]

    def validate(self) -> Model:
        for layer in self.layers:
            check_layer(self, layer)
        for sub in self.submodels.values():
            check_submodel(self, sub)
            sub.model.validate()
        return self


def nested(model: Model) -> set:
    own = {s.model for s in model.submodels.values()}
    return own | {x for m in own for x in nested(m)}


def check_function(model: Model, f: Function) -> None:
    agent = model.agents.get(f.agent)
    if agent is None:
        raise ModelError(f"{f.name}: unknown agent {f.agent}")
    for state in (f.initial, f.end):
        if state is not None and not agent.has_state(state):
            raise ModelError(f"{f.name}: unknown state {state}")
    if f.alive is not None and not f.allow_death:
        raise ModelError(f"{f.name}: it ends agents but does not allow death")
    if f.read and f.read.list_name is not None and f.read.message not in model.messages:
        raise MessageError(f"{f.name}: unknown message {f.read.message}")
    if f.emit:
        if f.emit.message not in model.messages:
            raise MessageError(f"{f.name}: unknown message {f.emit.message}")
        message = model.messages[f.emit.message]
        if unknown := f.emit.values.keys() - message.variables.keys() - set(message.keys):
            raise MessageError(f"{f.name}: {message.name} has no {sorted(unknown)}")
        if missing := set(message.keys) - f.emit.values.keys():
            raise MessageError(f"{f.name}: {message.name} needs {sorted(missing)}")
        if f.read and f.read.list_name == f.emit.message:
            raise MessageError(f"{f.name}: one list cannot be read and written by one function")
    if f.birth:
        if f.birth.agent not in model.agents:
            raise ModelError(f"{f.name}: unknown agent {f.birth.agent}")
        other = model.agents[f.birth.agent]
        if unknown := f.birth.values.keys() - other.variables.keys():
            raise ModelError(f"{f.name}: {other.name} has no {sorted(unknown)}")
        if f.birth.state is not None and not other.has_state(f.birth.state):
            raise ModelError(f"{f.name}: unknown state {f.birth.state}")
    if f.read and f.read.graph is not None and f.read.graph not in model.environment.graphs:
        raise EnvironmentError_(f"{f.name}: unknown graph {f.read.graph}")
    if f.read and f.read.macro is not None:
        if f.read.macro not in model.environment.macros:
            raise EnvironmentError_(f"{f.name}: unknown macro property {f.read.macro}")
        if len(f.read.fold) != 1:
            raise EnvironmentError_(f"{f.name}: a cell is read under one name")
        if f.macro and f.macro.macro == f.read.macro:
            raise LayerError(f"{f.name}: a macro property cannot be read and updated by one function")
    if f.macro:
        if f.macro.macro not in model.environment.macros:
            raise EnvironmentError_(f"{f.name}: unknown macro property {f.macro.macro}")
        how, kind = f.macro.how, model.environment.macros[f.macro.macro][0]
        if how not in MACRO_UPDATES:
            raise EnvironmentError_(f"{f.name}: unknown update {how}")
        if how in ("increment", "decrement") and kind != "uint32":
            raise EnvironmentError_(f"{f.name}: {how} is for uint32, not {kind}")
        if (how == "swap") != (f.macro.expected is not None):
            raise EnvironmentError_(f"{f.name}: a swap, and nothing else, has an expected value")
        if f.macro.result is not None and (how not in ("add", "exchange", "swap") or f.macro.result not in agent.variables):
            raise EnvironmentError_(f"{f.name}: the result of add, exchange or swap goes to a variable of the agent")


def states_of(model: Model, f: Function) -> set[tuple[str, str]]:
    first = model.agents[f.agent].first_state
    return {(f.agent, f.initial or first), (f.agent, f.end or f.initial or first)}


def clash(model: Model, f: Function, g: Function) -> str | None:
    """Why two functions may not share a layer, or None."""
    if f.name == g.name and f.agent == g.agent:
        return "the same function twice"
    if states_of(model, f) & states_of(model, g):
        return "they share a state"
    for x, y in ((f, g), (g, f)):
        if x.birth and (x.birth.agent, x.birth.state or model.agents[x.birth.agent].first_state) in states_of(model, y):
            return "one is born into a state the other uses"
        if x.emit and y.emit and x.emit.message == y.emit.message:
            return "both write one message list"
        if x.emit and y.read and y.read.list_name == x.emit.message:
            return "one reads what the other writes"
        if x.macro and y.read and y.read.macro == x.macro.macro:
            return "one reads the macro property that the other updates"
    return None


def check_layer(model: Model, layer: Layer) -> None:
    if bool(layer.functions) + (layer.host is not None) + (layer.submodel is not None) > 1:
        raise LayerError("a layer holds agent functions, or one host function, or one submodel")
    for i, f in enumerate(layer.functions):
        check_function(model, f)
        for g in layer.functions[:i]:
            if why := clash(model, f, g):
                raise LayerError(f"{f.name} and {g.name}: {why}")


def check_submodel(outer: Model, sub: SubModel) -> None:
    inner = sub.model
    if not inner.exit_conditions and not sub.max_steps:
        raise ModelError(f"submodel {sub.name}: it needs an exit condition or a greatest number of steps")
    for own, other in sub.agents.items():
        if own not in inner.agents or other not in outer.agents:
            raise ModelError(f"submodel {sub.name}: unknown agent {own} or {other}")
        used = list(sub.variables.get(own, {}).values())
        if len(set(used)) != len(used):
            raise ModelError(f"submodel {sub.name}: a variable is mapped twice")
        for a, b in sub.variables.get(own, {}).items():
            x, y = inner.agents[own].variables.get(a), outer.agents[other].variables.get(b)
            if x is None or y is None or (x.kind, x.length) != (y.kind, y.length):
                raise ModelError(f"submodel {sub.name}: {own}.{a} and {other}.{b} differ in type or length, or are unknown")
        for a, b in sub.states.get(own, {}).items():
            if not inner.agents[own].has_state(a) or not outer.agents[other].has_state(b):
                raise ModelError(f"submodel {sub.name}: unknown state {a} or {b}")
    for a, b in sub.properties.items():
        x, y = inner.environment.properties.get(a), outer.environment.properties.get(b)
        if x is None or y is None or (x.kind, x.length) != (y.kind, y.length):
            raise EnvironmentError_(f"submodel {sub.name}: properties {a} and {b} differ in type or length, or are unknown")
        if y.const and not x.const:
            raise EnvironmentError_(f"submodel {sub.name}: a constant cannot be mapped to a property that changes")
