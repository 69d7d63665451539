"""Importing this module registers every view."""

from tallyhouse.plans import attendance, cases, command_center, compliance, payroll, recruitment, talent, validators, workforce  # noqa: F401
from tallyhouse.plans.warehouse import VIEWS, Warehouse  # noqa: F401
