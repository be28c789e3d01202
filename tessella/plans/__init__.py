"""Plans that put operators together: analysis, candidates, scores, kits, exports, jobs."""
