"""Steps that several queries share are done once, and as wide as the session allows."""

from pathlib import Path

import pytest

from quillmark.operators import validate
from quillmark.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")


@pytest.mark.parametrize("name", ["validate_summary", "clean_standards"])
def test_citations_are_extracted_once(spark, monkeypatch, name):
    asked, own = [], validate.citations
    monkeypatch.setattr(validate, "citations", lambda docs: asked.append(docs) or own(docs))
    assert registry.queries()[name](spark, SF).count() > 0 and len(asked) == 1
