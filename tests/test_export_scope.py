"""The periods of an export's scope are few rows and are brought to the texts, not the texts to them."""

import re

from check_queries import DATA
from reportloom.operators import export
from reportloom.plans.databooks import export_reports
from reportloom.plans.views import Views
from test_search_tables import plan_text


def test_texts_are_not_dealt_by_period(spark):
    cells = export.databook_cells(export_reports(Views(spark, str(DATA))), ["Q2 1996", "Q1 1998"])
    assert not re.search(r"hashpartitioning\(period_id#\d+L?, \d+\)", plan_text(cells))
