import pytest

from wardcast.llm import queries
from wardcast.llm.shared import Scratch


class Session:
    """Just enough of a session to ask for its folder."""

    conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})()


def test_scratch_needs_a_shared_folder_and_goes_when_closed(spark, tmp_path):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        Scratch(Session())
    with Scratch(spark, str(tmp_path)) as scratch:
        assert scratch.save("ids", spark.range(3)).count() == 3
        assert len(list(tmp_path.iterdir())) == 1
    assert list(tmp_path.iterdir()) == []


def test_vocabularies_lie_where_their_package_says():
    import public_tokenizers

    assert queries.vocabulary("word_bpe_49k.json") == str(public_tokenizers.path("word_bpe_49k.json"))
    assert queries.vocabulary("a.json", "/x") == "/x/a.json"
