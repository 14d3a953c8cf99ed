"""The function catalogue: scalar functions over ``Val`` pairs, aggregates over columns."""

from tabulon.functions import dates, distributions, engineering, financial, logical, mathematics, text  # noqa: F401
from tabulon.functions.value import FUNCTIONS, Val, boolean, call, number, string  # noqa: F401
