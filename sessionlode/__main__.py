from sessionlode.cli import main

raise SystemExit(main())
