"""Example tables, made by rule from row numbers, so that any number of rows is the same on any cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: A number from 0 to 1 that a row's id and a column's number decide.
_U = "(pmod(xxhash64(id, {k}), 1000003) / 1000003.0)"
#: A bell-shaped number around 0 with a deviation of about 1.
_Z = "((" + " + ".join(_U.replace("{k}", f"{{k}} * 10 + {j}") for j in range(4)) + " - 2) * sqrt(3.0D))"


def _sql(text: str) -> str:
    """U<k> and Z<k> as the row's numbers."""
    import re

    return re.sub(r"\b([UZ])(\d+)\b", lambda m: (_U if m[1] == "U" else _Z).format(k=m[2]), text)


#: Name: (rows, columns as SQL over id, what it is for).
TABLES: dict[str, tuple[int, str, str]] = {
    "churn": (1_500, """id + 10001 as customer_id, date_format(date_add(date '2021-01-01', cast(U1 * 1000 as int)), 'dd/MM/yyyy') as signup_date, element_at(array('basic', 'plus', 'pro'), cast(U2 * 3 as int) + 1) as plan,
        case when U3 < 0.5 then 'monthly' else 'yearly' end as contract, case when U4 < 0.03 then null else concat('$', cast(round(20 + 80 * U5, 2) as string)) end as monthly_charges, cast(1 + 60 * U6 as int) as tenure_months,
        cast(6 * U7 * U8 as int) as support_calls, element_at(array('north', 'south', 'east', 'west'), cast(U9 * 4 as int) + 1) as region,
        concat('the service was ', case when U7 * U8 > 0.4 then 'slow and the help poor' else 'quick and the help kind' end, ' in month ', cast(cast(1 + 12 * U10 as int) as string)) as last_feedback,
        case when U7 * U8 * 3 + case when U3 < 0.5 then 0.5 else 0 end - U6 + 0.25 * Z11 > 0.95 then 'yes' else 'no' end as churned""", "classification of churned"),
    "house_prices": (1_200, """cast(600 + 2600 * U1 as int) as sqft, cast(1 + 5 * U2 as int) as bedrooms, round(1 + 2.5 * U3, 0) as bathrooms, cast(1930 + 90 * U4 as int) as year_built, element_at(array('harbour', 'hill', 'market', 'park'), cast(U5 * 4 as int) + 1) as neighborhood,
        element_at(array('fair', 'good', 'new'), cast(U6 * 3 as int) + 1) as condition, case when U7 < 0.04 then null else cast(3 * U8 as int) end as garage_spaces,
        round(50000 + (600 + 2600 * U1) * (110 + 20 * cast(U5 * 4 as int)) + 9000 * cast(U6 * 3 as int) + 700 * 90 * U4 + 9000 * Z9, -2) as price""", "regression of price"),
    "daily_sales": (912, """date_add(date '2022-01-01', cast(id as int)) as date, 'main' as store, cast(round(180 + id * 0.08 + element_at(array(0, 5, 8, 12, 40, 75, 20), weekday(date_add(date '2022-01-01', cast(id as int))) + 1) + 25 * sin(id * 0.0172) + 9 * Z1) as int) as units_sold""", "forecast of units_sold"),
    "customers": (600, """id + 1 as member_id, cast(greatest(18, case pmod(id, 3) when 0 then 24 + 3 * Z1 when 1 then 45 + 4 * Z1 else 67 + 4 * Z1 end) as int) as age, round(greatest(50, case pmod(id, 3) when 0 then 900 + 120 * Z2 when 1 then 5200 + 400 * Z2 else 2400 + 250 * Z2 end), 2) as annual_spend,
        round(greatest(0, case pmod(id, 3) when 0 then 14 + 2 * Z3 when 1 then 6 + 1 * Z3 else 2 + 0.6 * Z3 end), 1) as visits_per_month, element_at(array('app', 'shop', 'phone'), cast(case when U4 < 0.8 then pmod(id, 3) else cast(U5 * 3 as int) end as int) + 1) as preferred_channel""", "three groups"),
    "transactions": (3_000, """round(case when pmod(id, 100) = 7 then 2500 + 900 * U1 else exp(3.4 + 0.6 * Z2) end, 2) as amount, cast(case when pmod(id, 100) = 7 then 2 + 3 * U3 else 8 + 13 * U3 end as int) as hour, case when pmod(id, 100) = 7 then 'electronics' else element_at(array('food', 'travel', 'clothes', 'fuel'), cast(U4 * 4 as int) + 1) end as merchant_category,
        case when pmod(id, 100) = 7 then 'XX' else element_at(array('AA', 'BB'), cast(U5 * 2 as int) + 1) end as country, cast(1 + 5 * U6 as int) as items, cast(pmod(id, 100) = 7 as int) as is_fraud""", "unusual rows, marked in is_fraud"),
    "store_sales": (1_680, """date_add(date '2023-01-01', cast(id div 4 as int)) as date, concat('store ', cast(pmod(id, 4) + 1 as string)) as store, cast(pmod(id div 4, 9) = 0 as int) as promo,
        case when id div 4 < 406 then round((120 + 60 * pmod(id, 4)) * (1 + 0.6 * cast(pmod(id div 4, 9) = 0 as int)) * (1 + 0.15 * cast(weekday(date_add(date '2023-01-01', cast(id div 4 as int))) >= 5 as int)) + 6 * Z1, 1) end as sales""", "forecast of each store's sales, the last two weeks of which are plans"),
}


def names() -> dict[str, str]:
    """The tables, and what each is for."""
    return {k: v[2] for k, v in TABLES.items()}


def sample_table(spark: SparkSession, name: str, rows: int | None = None) -> DataFrame:
    """An example table, of its own size or of rows rows."""
    if name not in TABLES:
        raise ValueError(f"no table {name!r}; there are {', '.join(TABLES)}")
    n, columns, _ = TABLES[name]
    return spark.range(rows or n).selectExpr(*_split(_sql(columns)))


def _split(text: str) -> list[str]:
    """SQL expressions between commas that stand in no bracket and no quotes."""
    out, now, depth, quoted = [], "", 0, False
    for c in text:
        quoted ^= c == "'"
        depth += (c in "([") - (c in ")]") if not quoted else 0
        if c == "," and not depth and not quoted:
            out.append(now)
            now = ""
        else:
            now += c
    return [*out, now]
