"""Neural models behind an optional toolkit. It is absent where this engine is developed: these definitions are unverified, and say so when used."""

from __future__ import annotations

try:
    import torch
    from torch import nn
except ImportError:
    torch = None


def available() -> bool:
    return torch is not None


def _need() -> None:
    if torch is None:
        raise RuntimeError("the optional neural toolkit is not installed; these models are unverified")


def twin_tower(n_cell: int, n_drug: int, width: int = 128, dropout: float = 0.1):
    """Two encoders whose outputs are concatenated and mapped to one value."""
    _need()
    tower = lambda n: nn.Sequential(nn.Linear(n, width), nn.ReLU(), nn.Dropout(dropout), nn.Linear(width, width // 2), nn.ReLU())

    class TwinTower(nn.Module):
        def __init__(self):
            super().__init__()
            self.cell, self.drug, self.head = tower(n_cell), tower(n_drug), nn.Linear(width, 1)

        def forward(self, c, d):
            return self.head(torch.cat([self.cell(c), self.drug(d)], 1)).squeeze(1)

    return TwinTower()


def low_rank(n_cell: int, n_drug: int, rank: int):
    """mu + b(cell) + b(drug) + <u(cell), v(drug)> with centred factors; returns the components as well. rank 0 is the additive model."""
    _need()

    class LowRank(nn.Module):
        def __init__(self):
            super().__init__()
            self.mu = nn.Parameter(torch.zeros(()))
            self.bc, self.bd = nn.Linear(n_cell, 1), nn.Linear(n_drug, 1)
            self.u, self.v = (nn.Linear(n, max(rank, 1), bias=False) for n in (n_cell, n_drug))

        def forward(self, c, d):
            u, v = self.u(c), self.v(d)
            x = ((u - u.mean(0)) * (v - v.mean(0))).sum(1) if rank else torch.zeros(len(c))
            parts = {"mu": self.mu.expand(len(c)), "b_cell": self.bc(c).squeeze(1), "b_drug": self.bd(d).squeeze(1), "interaction": x}
            return sum(parts.values()), parts

    return LowRank()


def drug_equal_loss(pred, y, drug):
    """Mean over drugs of the mean squared error of each drug's rows in the batch."""
    _need()
    return torch.stack([((pred - y)[drug == d] ** 2).mean() for d in torch.unique(drug)]).mean()


def ranking_loss(pred, y, drug, most: int = 64, noise: float = 0.1, seed: int = 0):
    """Logistic loss on at most ``most`` sampled same-drug pairs whose labels differ by more than ``noise``."""
    _need()
    i, j = torch.triu_indices(len(y), len(y), 1)
    ok = (drug[i] == drug[j]) & ((y[i] - y[j]).abs() > noise)
    i, j = i[ok], j[ok]
    if not len(i):
        return pred.sum() * 0
    take = torch.randperm(len(i), generator=torch.Generator().manual_seed(seed))[:most]
    i, j = i[take], j[take]
    return nn.functional.softplus(-(pred[i] - pred[j]) * torch.sign(y[i] - y[j])).mean()


def distributed_fit(train_function, processes: int = 2, **arguments):
    """Run a training function through Spark's distributor."""
    _need()
    from pyspark.ml.torch.distributor import TorchDistributor

    return TorchDistributor(num_processes=processes, local_mode=False, use_gpu=False).run(train_function, **arguments)
