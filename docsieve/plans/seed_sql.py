"""DuckDB SQL that gives the same documents as the seeds, from their slots alone."""

from __future__ import annotations

from ..sources import seeds as S


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(options) -> str:
    return "[" + ", ".join(map(_quoted, options)) + "]"


def _draw(seed: int, *name: str) -> str:
    """The draw as a number; a name that is an SQL expression stands in brackets."""
    parts = " || ':' || ".join(f"({n[1:-1]})::VARCHAR" if n.startswith("(") else _quoted(n) for n in name)
    return f"('0x' || substr(md5('{seed}:' || k || ':' || {parts}), 1, {S.BITS // 4}))::BIGINT"


def _below(seed: int, n: int, *name: str) -> str:
    return f"({_draw(seed, *name)} % {n})::INT"


def _pick(seed: int, options, *name: str) -> str:
    return f"{_list(options)}[{_below(seed, len(options), *name)} + 1]"


def _cents(x: str) -> str:
    return f"(({x}) // 100)::VARCHAR || '.' || lpad((({x}) % 100)::VARCHAR, 2, '0')"


def _items(seed: int, name: str, items: S.Items) -> dict[str, str]:
    cents = [int(round(100 * float(p))) for p in S.PRICES]
    one = (
        f"{{'what': {_pick(seed, items.names, name, 'what', '(i)')}, 'n': {_below(seed, items.most, name, 'n', '(i)')} + 1,"
        f" 'price': {cents}[{_below(seed, len(cents), name, 'price', '(i)')} + 1]}}"
    )
    rows = f"list_transform(range({_below(seed, 3, name, 'count')} + 1), lambda i: {one})"
    text = f"x.what || ' x ' || x.n || ' @ $' || {_cents('x.price')} || ' = $' || {_cents('x.n * x.price')}"
    gold = f"""'{{"description":"' || x.what || '","line_total":"' || {_cents("x.n * x.price")} || '","quantity":' || x.n || ',"unit_price":"' || {_cents("x.price")} || '"}}'"""
    subtotal = f'list_sum(list_transform("{name}.rows", lambda x: x.n * x.price))::BIGINT'
    # half to even, in cents
    share = f'"{name}.sum" * {S.TAX_PERCENT}'
    tax = f"({share}) // 100 + (CASE WHEN ({share}) % 100 > 50 OR (({share}) % 100 = 50 AND (({share}) // 100) % 2 = 1) THEN 1 ELSE 0 END)"
    return {
        "rows": rows, "sum": subtotal, "duty": tax, "text": f'array_to_string(list_transform("{name}.rows", lambda x: {text}), chr(10))',
        "gold": f"""'[' || array_to_string(list_transform("{name}.rows", lambda x: {gold}), ',') || ']'""",
        "subtotal": _cents(f'"{name}.sum"'), "tax": _cents(f'"{name}.duty"'), "total": _cents(f'"{name}.sum" + "{name}.duty"'),
    }


def _turns(seed: int, name: str, turns: S.Turns) -> dict[str, str]:
    at = f"lpad(({_below(seed, 10, name, 'h', '(i)')} + 8)::VARCHAR, 2, '0') || ':' || lpad(({_below(seed, 60, name, 'm', '(i)')})::VARCHAR, 2, '0')"
    one = f"{{'who': CASE WHEN i % 2 = 0 THEN '{S.SPEAKERS[0]}' ELSE '{S.SPEAKERS[1]}' END, 't': {_pick(seed, turns.lines, name, 't', '(i)')}, 'at': {at}}}"
    rows = f"list_transform(range(1, {_below(seed, turns.high - turns.low + 1, name, 'count')} + {turns.low + 1}), lambda i: {one})"
    gold = """'{"speaker":"' || x.who || '","text":"' || x.t || '","timestamp":"' || x.at || '"}'"""
    return {
        "rows": rows, "text": f"""array_to_string(list_transform("{name}.rows", lambda x: '[' || x.at || '] ' || x.who || ' - ' || x.t), chr(10))""",
        "gold": f"""'[' || array_to_string(list_transform("{name}.rows", lambda x: {gold}), ',') || ']'""",
    }


def _rendered(template: str) -> str:
    parts = []
    for literal, slot, yes, no in S.pieces(template):
        parts += [_quoted(literal)] if literal else []
        if slot:
            parts.append(f"CASE WHEN \"{slot}\" = 'true' THEN {_quoted(yes)} ELSE {_quoted(no)} END" if yes or no else f'"{slot}"')
    return "(" + " || ".join(parts) + ")"


def _slots(seed: int, slots: dict[str, S.Slot]) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, slot in slots.items():
        match slot:
            case S.Pick(options, ""):
                out[name] = _pick(seed, options, name)
            case S.Pick(options, other):
                out[name] = f'list_filter({_list(options)}, lambda x: x <> "{other}")[{_below(seed, len(options) - 1, name)} + 1]'
            case S.Row(options):
                out |= {f"{name}.{i}": f"{_list(part)}[{_below(seed, len(options), name)} + 1]" for i, part in enumerate(zip(*options, strict=True))}
            case S.Number(low, high):
                out[name] = f"({_below(seed, high - low + 1, name)} + {low})::VARCHAR"
            case S.Day("", _, _):
                out[name] = f"make_date({_below(seed, 2, name, 'y')} + 2025, {_below(seed, 12, name, 'm')} + 1, {_below(seed, 28, name, 'd')} + 1)::VARCHAR"
            case S.Day(other, low, high):
                out[name] = f'("{other}"::DATE + {_below(seed, high - low + 1, name)} + {low})::VARCHAR'
            case S.Chance(share):
                out[name] = f"CASE WHEN {_draw(seed, name)} / {1 << S.BITS}.0::DOUBLE < {share} THEN 'true' ELSE 'false' END"
            case S.Text(template):
                out[name] = _rendered(template)
            case S.Items():
                out |= {f"{name}.{part}": x for part, x in _items(seed, name, slot).items()}
            case S.Turns():
                out |= {f"{name}.{part}": x for part, x in _turns(seed, name, slot).items()}
        if isinstance(slot, S.Pick):
            out[f"{name}.low"] = f"""lower(split_part("{name}", ' ', 1))"""
    return out


def _gold(gold: dict[str, str | S.Raw]) -> str:
    def value(slot: str | S.Raw) -> str:
        return f'"{slot.slot}"' if isinstance(slot, S.Raw) else f"""'"' || "{slot}" || '"'"""

    parts = []
    for key, slot in S.gold_shape(gold):
        if isinstance(slot, list):
            inside = " || ',' || ".join(f"""'"{leaf}":' || {value(of)}""" for leaf, of in slot)
            parts.append(f"""'"{key}":[{{' || {inside} || '}}]'""")
        else:
            parts.append(f"""'"{key}":' || {value(slot)}""")
    return "'{' || " + " || ',' || ".join(parts) + " || '}'"


def seed_sql(schema: str, ids: str, seed: int = 0) -> str:
    """record_id, schema, source_text, reference of the records whose ids ``ids`` selects as k."""
    one = S.SEEDS[schema]
    slots = ",\n  ".join(f'{x} AS "{name}"' for name, x in _slots(seed, one.slots).items())
    return f"""SELECT k AS record_id, '{schema}' AS schema, {_rendered(one.text)} AS source_text, {_gold(one.gold)} AS reference
FROM (SELECT k, {slots} FROM ({ids}))"""
