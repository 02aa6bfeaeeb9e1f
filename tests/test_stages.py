import numpy as np
import pytest

from alphaline.operators import kernels
from alphaline.operators import pixels as px
from alphaline.plans import stages


def failing():
    raise OSError("gone")


def test_a_failure_ends_a_run_and_its_events_stay():
    done = []
    steps = [stages.Stage("a", lambda: done.append(1)), stages.Stage("b", failing), stages.Stage("c", lambda: done.append(3))]
    with pytest.raises(stages.StageError) as error:
        stages.run_stages(steps)
    assert [e[1:3] for e in error.value.events] == [("a", "done"), ("b", "failed")] and done == [1]


def test_guards_refuse_and_tolerant_stages_need_one_success():
    with pytest.raises(stages.StageError, match="too few") as error:
        stages.run_stages([stages.Stage("a", failing, guard=lambda: "too few")])
    assert error.value.events == [(0, "a", "refused", "too few")]
    with pytest.raises(stages.StageError, match="no tolerant"):
        stages.run_stages([stages.Stage(n, failing, tolerant=True) for n in "ab"])
    assert stages.run_stages([stages.Stage("a", failing, tolerant=True), stages.Stage("b", failing, done=lambda: True, tolerant=True)])[1][2] == "skipped"


def test_cut_outs_keep_alpha_and_the_subject_s_colour():
    alpha = np.zeros((40, 40))
    alpha[10:30, 10:30] = 1
    alpha = px.gaussian(alpha, 1.5)
    red, blue = np.array([1.0, 0, 0]), np.array([0, 0, 1.0])
    image = alpha[..., None] * red + (1 - alpha[..., None]) * blue
    rgba = kernels.cut_out(lambda: lambda x: alpha, refine=False)()(image)
    assert (rgba[..., 3] == np.clip(alpha, 0, 1)).all()
    edge = (alpha > 0.3) & (alpha < 0.7)
    assert np.abs(rgba[edge, 2]).mean() < np.abs(image[edge, 2]).mean() / 2
    assert np.isfinite(px.decontaminated(image, np.zeros((40, 40)))).all()
