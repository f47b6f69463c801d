"""Whole contract logs: dispatch by the first topic, routing by the emitting contract, arguments to columns.

A log becomes an array of argument texts in the order of its signature, either from topics and data
or from JSON, and the arguments become columns. All in JVM columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.functions import abi

#: Rotations are generated below; a state of 25 lanes of 64 bits, 24 rounds, 136 bytes a block.
_LANES, _ROUNDS, _RATE = 64, 24, 136


def keccak256(message: bytes) -> bytes:
    """The original Keccak hash of 256 bits (not the later standard, whose padding differs)."""
    mask = (1 << _LANES) - 1
    turn = lambda v, n: ((v << n % _LANES) | (v >> (_LANES - n % _LANES))) & mask if n % _LANES else v

    def permute(a: list[list[int]]) -> list[list[int]]:
        register = 1
        for _ in range(_ROUNDS):
            parity = [a[x][0] ^ a[x][1] ^ a[x][2] ^ a[x][3] ^ a[x][4] for x in range(5)]
            a = [[a[x][y] ^ parity[x - 1] ^ turn(parity[(x + 1) % 5], 1) for y in range(5)] for x in range(5)]
            x, y, lane = 1, 0, a[1][0]
            for step in range(24):
                x, y = y, (2 * x + 3 * y) % 5
                lane, a[x][y] = a[x][y], turn(lane, (step + 1) * (step + 2) // 2)
            a = [[a[x][y] ^ (~a[(x + 1) % 5][y] & mask & a[(x + 2) % 5][y]) for y in range(5)] for x in range(5)]
            for bit in range(7):
                register = (register << 1) ^ (0x171 if register & 0x80 else 0)
                if register & 2:
                    a[0][0] ^= 1 << ((1 << bit) - 1)
        return a

    padded = bytearray(message) + bytearray(_RATE - len(message) % _RATE)
    padded[len(message)] ^= 0x01
    padded[-1] ^= 0x80
    state = [[0] * 5 for _ in range(5)]
    for start in range(0, len(padded), _RATE):
        for i in range(_RATE // 8):
            state[i % 5][i // 5] ^= int.from_bytes(padded[start + 8 * i : start + 8 * i + 8], "little")
        state = permute(state)
    return b"".join(state[i % 5][i // 5].to_bytes(8, "little") for i in range(4))


@dataclass(frozen=True)
class Layout:
    """Where a log keeps its arguments: ``t1`` is the first topic after the signature's, ``w0`` the first word of data."""

    frame: str
    signature: str
    places: tuple[str, ...]
    columns: tuple[str, ...]
    negated: str | None = None

    @property
    def kind(self) -> str:
        return self.signature.partition("(")[0]

    @property
    def types(self) -> list[str]:
        return self.signature.partition("(")[2].rstrip(")").split(",")

    @property
    def topic(self) -> str:
        return "0x" + keccak256(self.signature.encode()).hex()


#: Signatures of the two contracts' logs and the places of their arguments.
LAYOUTS = (
    Layout("pool", "Initialize(uint160,int24)", ("w0", "w1"), ("sqrt_price_x96", "tick")),
    Layout("pool", "Mint(address,address,int24,int24,uint128,uint256,uint256)", ("w0", "t1", "t2", "t3", "w1", "w2", "w3"), ("sender", "owner", "tick_lower", "tick_upper", "liquidity_delta_raw", "amount0_raw", "amount1_raw")),
    Layout("pool", "Burn(address,int24,int24,uint128,uint256,uint256)", ("t1", "t2", "t3", "w0", "w1", "w2"), ("owner", "tick_lower", "tick_upper", "liquidity_delta_raw", "amount0_raw", "amount1_raw"), "liquidity_delta_raw"),
    Layout("pool", "Swap(address,address,int256,int256,uint160,uint128,int24)", ("t1", "t2", "w0", "w1", "w2", "w3", "w4"), ("sender", "recipient", "amount0_raw", "amount1_raw", "sqrt_price_x96", "active_liquidity_raw", "tick")),
    Layout("pool", "Collect(address,address,int24,int24,uint128,uint128)", ("t1", "w0", "t2", "t3", "w1", "w2"), ("owner", "recipient", "tick_lower", "tick_upper", "amount0_raw", "amount1_raw")),
    Layout("manager", "IncreaseLiquidity(uint256,uint128,uint256,uint256)", ("t1", "w0", "w1", "w2"), ("token_id", "liquidity_delta_raw", "amount0_raw", "amount1_raw")),
    Layout("manager", "DecreaseLiquidity(uint256,uint128,uint256,uint256)", ("t1", "w0", "w1", "w2"), ("token_id", "liquidity_delta_raw", "amount0_raw", "amount1_raw"), "liquidity_delta_raw"),
    Layout("manager", "Collect(uint256,address,uint256,uint256)", ("t1", "w0", "w1", "w2"), ("token_id", "recipient", "amount0_raw", "amount1_raw")),
    Layout("manager", "Transfer(address,address,uint256)", ("t1", "t2", "t3"), ("from_address", "to_address", "token_id")),
)
ADDRESSES = ("sender", "owner", "recipient", "from_address", "to_address")
TICKS = ("tick_lower", "tick_upper", "tick")
INTEGERS = ("token_id", "liquidity_delta_raw", "amount0_raw", "amount1_raw", "sqrt_price_x96", "active_liquidity_raw")
BASE = ("block_number", "block_timestamp", "transaction_hash", "transaction_index", "log_index", "address")


def _error(message: Column | str, kind: str = "string") -> Column:
    return F.raise_error(F.concat(F.lit(message), F.lit("")) if isinstance(message, str) else message).cast(kind)


def _by_layout(test: Column, cells: list[Column | None]) -> Column:
    """The cell of the layout whose number equals ``test``."""
    out = None
    for i, cell in enumerate(cells):
        if cell is not None:
            out = F.when(test == i, cell) if out is None else out.when(test == i, cell)
    return out


def _told(test: Column, values: list) -> Column:
    """The same for literals, naming ``test`` once."""
    return F.get(F.array(*[F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v) for v in values]), test)


def _number(test: Column, names: list[str]) -> Column:
    """Number of the layout with this name, null for none."""
    return F.try_element_at(F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))]), test)


#: How an argument is read: an address, an unsigned or a signed integer.
_KINDS = {"address": 0, "uint": 1, "int": 2}


def _kind(kind: str) -> int:
    return _KINDS[kind if kind == "address" else kind.rstrip("0123456789")]


_KIND_LISTS = [[_kind(k) for k in x.types] for x in LAYOUTS]


def argument_words(topics: Column, data: Column, layout: Column) -> tuple[Column, Column]:
    """Array of the arguments' words, from topics (an array) and data, by number of the layout; and how each is read."""
    words = abi.words(data)
    word = lambda place: abi.topic_at(topics, int(place[1:])) if place[0] == "t" else F.coalesce(F.get(words, F.lit(int(place[1:]))), _error("missing word of data"))
    return _by_layout(layout, [F.array(*[word(p) for p in x.places]) for x in LAYOUTS]), _told(layout, _KIND_LISTS)


def argument_texts(words: Column, kinds: Column) -> Column:
    """The arguments as text."""
    return F.zip_with(words, kinds, lambda w, k: F.when(k == 0, abi.address_word(w)).otherwise(abi.integer_word(w, k == 2)))


def rejected(logs: DataFrame, pool: list[str], manager: list[str]) -> DataFrame:
    """Logs that cannot be decoded, with a ``reason``: 'removed', 'no topics', 'unknown topic', 'unknown contract' or 'wrong contract'."""
    return _sorted_out(logs, pool, manager).filter("reason IS NOT NULL").select(*logs.columns, "reason")


def _sorted_out(logs: DataFrame, pool: list[str], manager: list[str]) -> DataFrame:
    """Logs with ``topics``, the number of the layout, the frame of the contract and a reason against decoding."""
    names = {c.lower() for c in logs.columns}
    rows = logs.withColumn("__topics", abi.topic_list(F.col("topics_json")))
    number = _number(F.lower(F.get("__topics", F.lit(0))), [x.topic for x in LAYOUTS])
    contract = F.lower(F.trim("address"))
    frame = F.when(contract.isin([a.lower() for a in pool]), "pool").when(contract.isin([a.lower() for a in manager]), "manager")
    gone = F.coalesce(F.col("removed"), F.lit(False)) if "removed" in names else F.lit(False)
    rows = rows.withColumns({"__layout": number, "__frame": frame, "__gone": gone})
    own = _told(F.col("__layout"), [x.frame for x in LAYOUTS])
    empty = F.coalesce(F.size("__topics"), F.lit(-1)) < 1
    reason = F.when(F.col("__gone"), "removed").when(empty, "no topics").when(F.col("__layout").isNull(), "unknown topic").when(F.col("__frame").isNull(), "unknown contract").when(F.col("__frame") != own, "wrong contract")
    return rows.withColumn("reason", reason)


def decode_logs(logs: DataFrame, pool: list[str], manager: list[str]) -> DataFrame:
    """Logs of the pool and its position manager as event rows, in one table with a ``frame`` column.

    logs: ``BASE`` columns, ``topics_json`` (a JSON list), ``data`` and optionally ``removed``.
    Anything in ``rejected`` is an error, as are missing words and topics. Result: see ``events_from_arguments``.
    """
    rows = _sorted_out(logs, pool, manager)
    rows = rows.filter(F.when(F.col("reason").isNull(), True).otherwise(_error(F.concat(F.lit("log cannot be decoded: "), F.col("reason")), "boolean")))
    words, kinds = argument_words(F.col("__topics"), F.col("data"), F.col("__layout"))
    signature = _told(F.col("__layout"), [x.signature for x in LAYOUTS])
    rows = rows.select(*BASE, F.col("__frame").alias("frame"), signature.alias("event_signature"), words.alias("__words"), kinds.alias("__kinds"))
    rows = rows.withColumn("args_json", F.to_json(argument_texts(F.col("__words"), F.col("__kinds")))).drop("__words", "__kinds")
    return events_from_arguments(rows)


def events_from_arguments(rows: DataFrame) -> DataFrame:
    """Events with columns for their arguments, from ``event_signature`` and ``args_json`` (a JSON list of texts or numbers).

    An unknown signature, a wrong number of arguments, a null or malformed argument is an error.
    Hashes and addresses come out in lower case, integers as canonical text, ticks as int. The
    liquidity of what leaves a position (Burn, DecreaseLiquidity) is negated. Columns that do not
    belong to an event are null. ``event_type`` is the signature's name.
    """
    number = _number(F.col("event_signature"), [x.signature for x in LAYOUTS])
    rows = rows.withColumns({"__layout": F.coalesce(number, _error("unsupported signature", "int")), "__args": F.from_json("args_json", "array<string>")})
    rows = rows.withColumn("__kinds", _told(F.col("__layout"), _KIND_LISTS))
    rows = rows.withColumn("__args", F.when(F.size("__args") == F.size("__kinds"), F.col("__args")).otherwise(_error("wrong number of arguments", "array<string>")))

    def value(text: Column, kind: Column) -> Column:
        address = F.lower(text)
        return F.when(text.isNull(), _error("missing argument")).when(kind != 0, abi.integer_text(text)).when(address.rlike("^0x[0-9a-f]{40}$"), address).otherwise(_error("malformed address"))

    rows = rows.withColumn("__args", F.zip_with("__args", "__kinds", value))
    place = lambda c: [x.columns.index(c) if c in x.columns else 99 for x in LAYOUTS]
    cells = {c: F.get("__args", _told(F.col("__layout"), place(c))) for c in (*ADDRESSES, *TICKS, *INTEGERS)}
    rows = rows.select("*", *[(c.cast("int") if n in TICKS else c).alias(n) for n, c in cells.items()])
    leaves = _told(F.col("__layout"), [x.negated is not None for x in LAYOUTS])
    amount = F.col("liquidity_delta_raw")
    turned = F.when(~leaves | (amount == "0"), amount).when(amount.startswith("-"), F.substring(amount, 2, 100)).otherwise(F.concat(F.lit("-"), amount))
    kind = _told(F.col("__layout"), [x.kind for x in LAYOUTS])
    changed = {"transaction_hash": F.lower("transaction_hash"), "address": F.lower(F.trim("address")), "liquidity_delta_raw": turned}
    return rows.select(*[changed.get(c, F.col(c)).alias(c) for c in rows.columns if not c.startswith("__")], kind.alias("event_type"))
