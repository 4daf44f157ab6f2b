"""Regime models of one series: small numpy kernels, and the grouped maps that run them over all series, blocks and restarts."""
