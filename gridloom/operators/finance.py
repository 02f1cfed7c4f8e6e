"""Annuities and annualised costs as Column expressions (RES-6 to RES-9)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pv_of_annuity(rate: Column, years: Column) -> Column:
    """P/A: present value of one a year, at the ends of so many years; the years themselves at rate zero."""
    return F.when(rate == 0, years.cast("double")).otherwise((F.lit(1.0) - F.pow(1 + rate, -years)) / rate)


def annuity_of_pv(rate: Column, years: Column) -> Column:
    """A/P."""
    return F.when(rate == 0, F.lit(1.0) / years).otherwise(rate / (F.lit(1.0) - F.pow(1 + rate, -years)))


def pv_of_future(rate: Column, years: Column) -> Column:
    """P/F: present value of one after so many years."""
    return F.pow(1 + rate, -years)


def loan_cost(capacity: Column, invest: Column, loan_rate: Column, loan_life: Column, rate: Column, life: Column, start: Column, end: Column, vintage: Column) -> tuple[Column, Column]:
    """(discounted, undiscounted) investment cost of a build: a loan paid off in annuities, its value spread over the process life and counted up to the horizon.

    start and end bound the horizon; rate discounts to start; what of the life lies beyond the end is left out.
    """
    annuity = capacity * invest * annuity_of_pv(loan_rate, loan_life)
    at_build = annuity * pv_of_annuity(rate, loan_life)  # all payments, valued in the vintage year
    counted = F.least(life, end - vintage)
    discounted = at_build * annuity_of_pv(rate, life) * pv_of_annuity(rate, counted) * pv_of_future(rate, vintage - start)
    return discounted, annuity * loan_life / life * counted


def yearly_cost(value: Column, cost: Column, rate: Column, length: Column, start: Column, period: Column) -> tuple[Column, Column]:
    """(discounted, undiscounted) cost of `value * cost` in each year of a period."""
    return value * cost * pv_of_annuity(rate, length) * pv_of_future(rate, period - start), value * cost * length
