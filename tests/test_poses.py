"""Code made for pose queries."""

import pytest

from photoflow.plans import registry


@pytest.mark.parametrize("name", ["b24_upper_body_box", "b26_pose_features", "b28_classify_action_simple", "b37_landmarks_to_image"])
def test_methods_are_small_enough_to_be_compiled(spark, name):
    made = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().debug().codegenToSeq()
    assert made.size() and max(made.apply(k)._3().maxMethodCodeSize() for k in range(made.size())) < 8000
