"""The evaluation kept up to date as logs arrive."""
